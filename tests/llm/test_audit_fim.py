import collections
import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import audit, fim

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, id long, n int, form string"
LABELS = "doc_id long, quality int, toxic int, text string, source string"


def rows():
    long_ = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [None, "", " \t\n", "one", "ABC def", "a | b", long_, long_, long_ + " END", "rep " * 300, "Über 日本 x\u0085y \x1cz\x0b", "x <P> y z", "a <S", "< <M", "  lead", "trail  \n", "a\x00b c", "𝒳 𝒴 🎉 é"]
    out = [(i, t, "en", None if i % 5 == 0 else "" if i % 5 == 1 else f"s{i % 3}", None, "p", 9, 9, 9, "f") for i, t in enumerate(texts)]
    out += [out[4], out[4], out[6][:3] + ("other",) + out[6][4:], (None, "one", None, None, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None, None, None)]
    out += [(100 + i, f"a b <{'PSM'[i % 3]} word{i} <\n> x{i} y z" * (i % 5), None, "s2", None, "p", 9, 9, 9, "f") for i in range(60)]
    return out


def labelled():
    return [(i, i % 2, None if i % 3 else 1, "t", "s") for i in range(0, 130, 2)] + [(4, 1, 1, "t", "s"), (4, 0, None, "t", "s"), (None, 1, 1, None, None), (999, 1, 1, None, None)]


def audited(docs, labels):
    """The contract, document by document and order by order."""
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    ids = collections.defaultdict(set)
    for d, t, *_ in docs:
        if d is not None:
            ids[t or ""].add(d)
    state = []
    for d, t, _, source, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": d is not None and d > min(ids[t])}
        state.append((source or "", {x for x, y in fails.items() if y}, d in good, d in toxic))
    out, shapley = {}, collections.Counter()
    for part in {s[0] for s in state}:
        for order in itertools.permutations("ABCDE"):
            left = [s for s in state if s[0] == part]
            gone = []
            for k, c in enumerate(order):
                lost = [s for s in left if c in s[1]]
                redundant = sum(c in s[1] for s in gone)
                left = [s for s in left if c not in s[1]]
                gone += lost
                unique = sum(s[0] == part and s[1] == {c} for s in state)
                out[part, "".join(order), k + 1] = (len(left), len(lost), redundant, unique, sum(s[2] for s in lost), sum(s[3] for s in lost))
                shapley[part, c] += len(lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    docs, labels = rows(), labelled()
    got = audit.orders(audit.cells(audit.masks(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(labels, LABELS)))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    found = [tuple(r) for r in got.collect()]
    wanted = audited(docs, labels)
    assert len(found) == len(wanted) and {r[:3]: r[3:] for r in found} == wanted


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.orders(audit.cells(audit.masks(docs), labels)).count() == 0
    got = audit.orders(audit.cells(audit.masks(spark.createDataFrame(rows(), DOCS)), labels))
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == audited(rows(), [])


def test_audit_stays_native(spark):
    plan = audit.orders(audit.cells(audit.masks(spark.createDataFrame(rows(), DOCS)), spark.createDataFrame(labelled(), LABELS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def cut(doc_id, text, seed=42, rate=50, spm=80):
    """The contract for one row: n, form, prefix, middle, output."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (100, 100), (0, 80)])
def test_fill_in_middle(spark, rate, spm):
    df = spark.createDataFrame(rows(), DOCS)
    made = fim.transform(df, rate=rate, spm=spm)
    wanted = collections.Counter()
    for d, t, *_ in rows():
        n, form, _, _, output = cut(d, t, 42, rate, spm)
        wanted[d, n, form, output] += 1
    assert collections.Counter(tuple(r) for r in made.collect()) == wanted
    back = collections.Counter((r.doc_id, r.text) for r in fim.restore(made).collect())
    assert back == collections.Counter((d, t or "") for d, t, *_ in rows())


def test_fill_in_middle_digests(spark):
    for docs, folder in ((spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "/root/testdata/sf0.001"),):
        got = fim.op12_fill_in_middle(spark, folder)
        assert [f"{n} {t}" for n, t in got.dtypes] == ["doc_id bigint", "n bigint", "form string", "prefix_chars bigint", "middle_chars bigint", "output_sha256 string", "restored_sha256 string"]
        wanted = collections.Counter()
        for r in docs.collect():
            n, form, p, m, output = cut(r.doc_id, r.text)
            wanted[r.doc_id, n, form, None if p is None else len(p), None if m is None else len(m), hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert collections.Counter(tuple(r) for r in got.collect()) == wanted
        assert {"plain", "psm", "spm"} == {r.form for r in got.select("form").distinct().collect()}
    empty = spark.createDataFrame([], DOCS)
    assert fim.transform(empty).count() == 0 and fim.restore(fim.transform(empty)).count() == 0
    assert fim.restore(spark.createDataFrame([(1, None, "x")], "doc_id long, form string, output string")).where(F.col("text").isNull()).count() == 1
