"""The question chain reads whole texts and parses each response once."""

import contextlib
import io

from pyspark.sql import functions as F

from examlytics.operators import parse as P
from examlytics.plans import catalog, fixtures as fx
from paths import SF_SMALL


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_each_response_is_parsed_once(spark):
    rows = spark.createDataFrame([("a", "{}", None)], "prompt_id string, raw string, section string").where(F.length("raw") > 1)
    chain = plan(P.questions_from_responses(rows, section_col="section"))
    assert chain.count("parseJson") == 1 and chain.count("regexp_extract") <= 3
    state = plan(P.completion_state(rows))
    assert state.count("parseJson") == 1 and state.count("regexp_extract") <= 3


def test_registered_chain_does_not_repeat_itself(spark):
    whole = plan(catalog.QUERIES["question_chain"](spark, SF_SMALL))
    assert whole.count("parseJson") == 2 and whole.count("regexp_extract") <= 6      # two branches: documents and broken replies


def test_responses_hold_every_sentence(spark):
    raw = fx.question_responses(spark, SF_SMALL).where("prompt_id like 'q:%'")
    lines = F.size(F.split(F.get_json_object("raw", "$.choices[0].message.content"), "\n"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert raw.select(F.max(lines)).first()[0] > 7
    assert raw.select(F.sum(F.length("raw"))).first()[0] > docs.select(F.sum(F.length("text"))).first()[0]
