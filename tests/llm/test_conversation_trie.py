import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from examlytics.llm import conversation_trie as m

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    """The trie by definition: every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        own[c].append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}"), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 4
        base = own.get(c - c % 20, []) if c is not None else []
        built[c] = tuple(base[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    order = lambda c: (c is not None, c or 0)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * words
    out = []
    for p, cs in members.items():
        ends = sorted((c for c in cs if len(built[c]) == len(p)), key=order)
        out.append((min(cs, key=order), len(p), min(members[p[:-1]], key=order) if p else None, len(cs), kids[p], leaves[p], saved[p],
                    sha(",".join("" if c is None else str(c) for c in ends))))
    return Counter(out)


def got(table, **options):
    return Counter(tuple(r) for r in m.trie(table, **options).drop("key", "parent_key").collect())


def conversations(seed, n, longest, variety):
    """Conversations that share long prefixes, some with copies, none or few turns, repeated and unordered turns and nulls."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        script = rng.randrange(3)
        for t in range(rng.choice([1, 2, longest, rng.randint(1, longest)])):
            odd = rng.random() < variety
            text = f"say {t} of {script}" + (f" or {rng.randrange(3)}" if odd else "")
            rows.append((c, t, "user" if t % 2 else "assistant", text, "k", 1))
    rows += [(700, None, None, None, None, None), (700, None, "user", "b a", None, None), (700, 2, "user", "", None, None), (700, 2, "user", "", None, None),
             (None, 0, "user", "say 0 of 1", None, 0), (None, 1, "assistant", "x", None, 0), (41, 0, "user", None, "", 0), (43, 5, None, "say", "", 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, longest, variety, height", [(1, 60, 8, 0.3, 16), (2, 30, 40, 0.02, 3), (3, 12, 90, 0.01, 2), (4, 40, 17, 0.05, 16)])
def test_matches_brute_force(spark, seed, n, longest, variety, height):
    rows = conversations(seed, n, longest, variety)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), height=height) == expected(rows)


def test_one_conversation_in_many_blocks(spark, monkeypatch):
    """A conversation far longer than a block, and its copies."""
    monkeypatch.setattr(m, "BLOCK", 8)
    rows = [(c, t, "user", f"t{t % 5}" if t < 150 + c else "x", None, None) for c in (0, 20, 40) for t in range(200)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_digests_of_many_ids_in_runs(spark):
    ends = spark.range(1000).select(F.unhex(F.lpad(F.hex(F.col("id") % 3), 4, "0")).alias("key"), (F.col("id") * 7 % 1000 - 300).alias("conv")).repartition(4)
    made = {bytes(r.key)[-1]: r.ends_sha256 for r in m._id_digests(ends, most=7).collect()}
    want = defaultdict(list)
    for i in range(1000):
        want[i % 3].append(i * 7 % 1000 - 300)
    assert made == {k: sha(",".join(map(str, sorted(v)))) for k, v in want.items()}


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, 0, "user", "a", None, None)] * 3 + [(2, 0, "user", "a", None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(table) == expected(rows)
    assert m.trie(table.limit(0)).count() == 0
