"""spark-submit entry points: ``python -m examlytics.jobs <job> [options]``.

Master, memory and shuffle partitions are those of the submission.  Each job
reads Parquet tables with the domain's own columns, runs the operators and
writes Parquet (or runs a stream).  Scratch state goes under the shared folder
named in ``spark.checkpoint.dir``; a stream's checkpoint lies beside its store
unless a path is given, so that the next run goes on where the last one ended.

  results    evaluations (record_id, examiner_name, student_name, roll_number, department, project_title, result,
             saved_at) -> append to the results store (``--load`` names the append: repeated, it replaces itself)
  stream     the same as a Structured Streaming job into the same store
  compact    results store: merge each day's loads into sized files and swap them; remove what is not live after --retain-hours
  terminations  violations (session_id, ts, event_id) as a stream -> sessions that must end (--sink parts, --out table)
  merge      a stream's table (--sink, --kind violations, answers or terminations): merge its micro-batches and swap, while it runs
  dashboard  results store -> kpis / status / departments / marks series, from the states and the series kept beside it
  prompts    settings (doc_id, mode, section, difficulty, style, text) -> question prompts
  questions  responses (key, raw JSON, optional section) -> six questions per response
  grades     responses (prompt_id, kind, raw JSON) -> content of grading and model-answer calls (--prompts prompt_id, kind: one
             row for every prompt, answered or not)
  sessions   typed and spoken answers, sessions (session_id, mode, n_questions), violations -> answers, progress,
             resume points and finished sessions, without the terminated ones (--sink: those of a running terminations stream)
  final      questions (session_id, idx, question), answers, students -> final evaluation prompts
  reports    results store -> report table (latest record per roll number); with --latest from a table of latest records that is
             brought up to date with the store's new loads (--roll: one student's report)
  search     results store -> records whose student name matches --pattern, through the trigram index beside the store
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dashboard as D
from .operators import parse as P
from .operators import prompts as B
from .operators import results as R
from .operators import sessions as S
from .schemas import EVALUATIONS, VIOLATIONS
from .session import get_spark
from .sources import dashboard_store, name_index, reports, results_store
from .streaming import batches
from .streaming import streams as G


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    read = spark.read.parquet
    if args.job == "results":
        results_store.results_append(R.result_build(read(args.input)), args.store, args.load)
    elif args.job == "stream":
        checkpoint = args.checkpoint or f"{args.store.rstrip('/')}.checkpoint"
        raw = G.read_stream(spark, args.input, EVALUATIONS, args.max_files)
        G.results_stream(raw, checkpoint, args.store, trigger_available_now=args.once).awaitTermination()
    elif args.job == "compact":
        results_store.compact(spark, args.store, args.min_parts)
        results_store.vacuum(spark, args.store, args.retain_hours)
    elif args.job == "merge":
        if args.kind == "terminations":
            G.merge_terminations(spark, args.sink, min_parts=args.min_parts)
        else:
            G.merge_latest(spark, args.sink, STREAM_KEYS[args.kind], min_parts=args.min_parts)
        batches.vacuum(spark, args.sink, args.retain_hours)
    elif args.job == "terminations":
        checkpoint = args.checkpoint or f"{args.sink.rstrip('/')}.checkpoint"
        rows = G.read_stream(spark, args.input, VIOLATIONS, args.max_files)
        G.terminations_stream(rows, checkpoint, args.sink, trigger_available_now=args.once).awaitTermination()
        _write(G.terminations(spark, args.sink), args.out)
    elif args.job == "dashboard":
        states = dashboard_store.states(spark, args.store, args.date_from, args.date_to)
        _write(dashboard_store.overview_kpis(states), f"{args.out}/kpis")
        _write(D.value_counts(states, "status", "n", "first"), f"{args.out}/status")
        _write(D.value_counts(states, "department", "n", "first"), f"{args.out}/departments")
        _write(dashboard_store.marks_series(spark, args.store, args.date_from, args.date_to), f"{args.out}/marks_series")
    elif args.job == "prompts":
        _write(B.prompt_questions(read(args.input)), args.out)
    elif args.job == "questions":
        rows = read(args.input)
        section = "section" if "section" in rows.columns else None
        _write(P.questions_from_responses(rows, args.key, section_col=section), args.out)
    elif args.job == "grades":
        rows = read(args.input)
        if args.prompts:     # a prompt whose call gave no response has an outcome too
            kinds = [P.completion_for_prompts(read(args.prompts).where(F.col("kind") == k), rows, "prompt_id", k) for k in P.FALLBACK_BY_KIND]
            _write(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), args.out)
        else:
            _write(P.completion_extract(rows), args.out)
    elif args.job == "sessions":
        log = S.merge_channels(read(args.typed), read(args.voice)) if args.voice else S.blank_answer_filter(read(args.typed))
        sessions = read(args.sessions)
        active = S.exclude_terminated(sessions, S.violations_terminate(read(args.violations))) if args.violations else sessions
        active = S.exclude_terminated(active, G.terminations(spark, args.sink)) if args.sink else active
        _write(S.answer_upsert(log), f"{args.out}/answers")
        _write(S.progress(log, sessions=active), f"{args.out}/progress")
        _write(S.resume_point(log, sessions=active), f"{args.out}/resume")
        _write(S.final_gate(log, active), f"{args.out}/finished")
    elif args.job == "final":
        transcripts = S.transcript_assemble(read(args.input), read(args.answers), "session_id")
        _write(B.prompt_final(transcripts, read(args.students), "session_id"), args.out)
    elif args.job == "reports":
        if args.latest:
            reports.refresh_latest(spark, args.store, args.latest)
            reports.vacuum_latest(spark, args.latest, args.retain_hours)
            rows = reports.render_reports(reports.latest_records(spark, args.latest, args.roll))
        else:
            rows = reports.report_text(results_store.saved_results(spark, args.store))
        reports.write_reports(rows, args.out)
    elif args.job == "search":
        _write(name_index.indexed_search(spark, args.store, args.pattern), args.out)
    else:  # pragma: no cover - argparse restricts the choices
        raise ValueError(args.job)


STREAM_KEYS = {"violations": ["session_id"], "answers": ["session_id", "idx"]}
JOBS = ["results", "stream", "compact", "terminations", "merge", "dashboard", "prompts", "questions", "grades", "sessions", "final", "reports", "search"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="examlytics.jobs", description=__doc__,
                                formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=JOBS)
    for name, what in [("input", "input table"), ("store", "results store path"), ("sink", "terminations: parts path"), ("out", "output path"),
                       ("typed", "typed answers"), ("voice", "spoken answers"), ("sessions", "sessions"), ("violations", "violations"),
                       ("answers", "final answers"), ("students", "student attributes"), ("checkpoint", "stream checkpoint"),
                       ("load", "results: name of this append"), ("prompts", "grades: all prompts"), ("latest", "reports: table of latest records"), ("roll", "reports: one roll number"),
                       ("pattern", "search: regular expression")]:
        p.add_argument(f"--{name}", help=what)
    p.add_argument("--key", default="prompt_id")
    p.add_argument("--date-from")
    p.add_argument("--date-to")
    p.add_argument("--kind", choices=[*STREAM_KEYS, "terminations"], default="terminations", help="merge: what the table holds")
    p.add_argument("--min-parts", type=int, default=8, help="compact, merge: nothing is rewritten below this number of parts (a day)")
    p.add_argument("--retain-hours", type=float, default=168.0, help="compact, merge: how long replaced files stay for readers")
    p.add_argument("--max-files", type=int, help="streams: files per micro-batch")
    p.add_argument("--once", action="store_true", help="streams: process what is there, then stop")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(get_spark(app_name=f"examlytics-{args.job}"), args)


if __name__ == "__main__":
    main()
