import itertools
import random

import pytest

from examlytics.llm import decontaminate as m


def test_masks_lose_no_pattern():
    """Every placing of the allowed substitutions leaves a whole mask untouched."""
    lost = {}
    for n in range(m.MIN_ITEM, m.WINDOW + 1):
        k = n * (100 - m.PERCENT) // 100
        masks = [sum(1 << i for i, c in enumerate(mask) if c == "1") << s for mask in m.MASKS for s in range(n - len(mask) + 1)]
        lost[n] = sum(all(p & sum(1 << i for i in e) for p in masks) for e in itertools.combinations(range(n), k))
    assert lost[m.WINDOW] == 0
    assert sum(lost.values()) <= 8, lost  # few patterns of the shortest items


def tokens(t):
    out, word = [], ""
    for c in (t or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def leaks(doc, item):
    a, b = tokens(doc), tokens(item)
    if len(b) < m.MIN_ITEM:
        return False
    w = min(m.WINDOW, len(b))
    return any(sum(x == y for x, y in zip(a[i:i + w], b[j:j + w])) * 100 >= w * m.PERCENT
               for i in range(len(a) - w + 1) for j in range(len(b) - w + 1))


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    items = [(i, prose(rng.choice([6, 12, 24, 40]))) for i in range(12)] + [(None, prose(30)), (50, None), (51, ""), (3, prose(25))]
    docs = [(i, prose(rng.randint(0, 120))) for i in range(30)]
    for i, t in items[:13] * 3:
        w = t.split()
        for at in rng.sample(range(len(w)), len(w) * rng.choice([0, 1, 2, 4]) // 10):
            w[at] = "QQ"
        docs.append((len(docs), f"{prose(rng.randint(0, 9))}, {' '.join(w).upper()}! {prose(rng.randint(0, 30))}"))
    docs += [(900, None), (901, ""), (None, items[3][1]), docs[-1], docs[-1]]
    return docs, items, spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, __key long"), \
        spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(case):
    docs, items, df, bench = case
    found = {(r["__id"], r["__item"]) for r in m.contaminated(df, bench).collect()}
    assert found == {(d, i) for d, t in docs for i, p in items if p and leaks(t, p)}
    kept = m.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(kept.select("text").collect(), key=str) == sorted(
        ((t,) for _, t in docs if not any(leaks(t, p) for _, p in items if p)), key=str)


def test_full_filter_changes_nothing(case, monkeypatch):
    """A bit table that is all but full (a large benchmark) only costs work."""
    docs, items, df, bench = case
    before = {tuple(r) for r in m.contaminated(df, bench).select("__id", "__item").collect()}
    monkeypatch.setattr(m, "FILTER_BITS", 7)
    assert {tuple(r) for r in m.contaminated(df, bench).select("__id", "__item").collect()} == before


def test_empty_tables(case):
    _, _, df, bench = case
    assert m.contaminated(df, bench.limit(0)).count() == 0
    assert m.drop_contaminated(df, bench.limit(0)).count() == df.count()
    assert m.contaminated(df.limit(0), bench).count() == 0


def test_every_length_has_masks_for_every_pattern():
    for n in range(1, m.WINDOW + 1):
        k = n * (100 - m.PERCENT) // 100
        own = [mask for mask, lengths in zip(m.MASKS, m.LENGTHS) if lengths is None or n in lengths]
        masks = [sum(1 << i for i, c in enumerate(mask) if c == "1") << s for mask in own for s in range(n - len(mask) + 1)]
        assert all(any(not p & sum(1 << i for i in e) for p in masks) for e in itertools.combinations(range(n), k)), n


def test_short_items_and_scripts_without_spaces(spark):
    def words(n):
        return [f"t{n}x{i}" for i in range(n)]

    items = [(n, " ".join(words(n))) for n in range(1, 16)]
    items += [(100, "中国的首都是哪一座城市"), (101, "日本で一番高い山は何ですか"), (102, "ประเทศไทยมีกี่จังหวัด"), (103, "𠀀𠀁𠀂")]
    docs, expected = [], set()

    def doc(text, item=None):
        docs.append((len(docs), text))
        if item is not None:
            expected.add((len(docs) - 1, item))

    for n in range(1, 16):
        k = n // 5
        for e in itertools.combinations(range(n), k):
            if n < 9 or e in ((1, 4), (2, 4), (2, 5), (2, 8), (5, 7, 9)):
                doc("before " + " ".join("sub" if i in e else w for i, w in enumerate(words(n))).upper() + " after", n)
        doc(" ".join("sub" if i <= k else w for i, w in enumerate(words(n))))  # one substitution too many
    doc("前文中国的首都是哪一座城市呢后文", 100)
    doc("「日本で、一番高い山は何ですか?」", 101)
    doc("ก่อนประเทศไทยมีกี่จังหวัดหลัง", 102)
    doc("x𠀀𠀁𠀂y", 103)
    doc("中国的城市")
    found = m.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["__id"], r["__item"]) for r in found.collect()} == expected
