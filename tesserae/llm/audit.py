"""Filter interaction audit: which filter removes what in every order, from one histogram of failure masks.

Every document gets a mask with a bit for each filter that it fails. The first four filters read the text alone. The
fifth fails texts that a smaller doc_id has too: texts are grouped by their SHA-256, the group gives its least doc_id, and
a row passes if (digest, doc_id) is such a pair; that join is on the id, so a text with a third of all rows is no hot key.
Masks are counted by part; all orders and steps are sums over the at most 32 cells of a part.

Nulls: a null text is empty, a null part is the empty string, a row without id is never a repeat (no id is smaller) and has
no label. Rows of one id and one text count each; the least id passes wherever it occurs. Of several label rows of an id
one with 1 suffices; labels of other ids count nothing. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, save

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
LETTERS = "ABCDE"


def text_failures(text: Column, words: Column) -> list[Column]:
    """Conditions of the filters A to D: few words, few distinct words, many capitals, marks."""
    n = F.size(words)
    return [
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * LEAST_DISTINCT,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * MOST_CAPITALS,
        text.rlike(MARKS),
    ]


def masks(docs: DataFrame, key: str = "doc_id", part: str = "source") -> DataFrame:
    """(id, part, mask, n): rows by what they fail, equal ids of equal texts counted together; one pass over the texts."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("text"), F.col("words")))]
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    seen = save(rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "masks")
    firsts = seen.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = seen.where("id is not null").join(firsts, ["id", "digest"], "left")
    again = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    return known.select("id", "part", F.col("mask").bitwiseOR(again).alias("mask"), "n").unionByName(seen.where("id is null").select("id", "part", "mask", "n"))


def cells(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows, rows of quality 1 and rows of toxic 1 by part and mask."""
    flags = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flagged = masked.where("id is not null").join(flags, "id", "left").unionByName(masked.where("id is null"), allowMissingColumns=True)
    of = lambda flag: F.sum(F.coalesce(F.col(flag), F.lit(0)) * F.col("n"))
    return flagged.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def steps(letters: str = LETTERS) -> list[dict]:
    """Every order of the filters, step by step: the bit of the step's filter and the bits of those before it."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    return [{"filter_order": "".join(o), "step": k + 1, "bit": bit[c], "before": sum(bit[x] for x in o[:k])} for o in itertools.permutations(letters) for k, c in enumerate(o)]


def orders(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """All orders and steps of each part from its cells.

    A filter removes a document in orders where it comes first among those that fail it: in 1 of m orders of m such filters.
    """
    every = math.factorial(len(letters))
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic", F.bit_count("mask").alias("fails"))).alias("cells"))  # at most 32
    plan = F.from_json(F.lit(json.dumps(steps(letters))), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = by_part.select("part", "cells", F.inline(plan))
    bit, before = F.col("bit"), F.col("before")

    def total(where, value) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda have, c: have + value(c))

    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    present = lambda c: c["mask"].bitwiseAND(before) == 0
    removed = lambda c: fails(c) & present(c)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["mask"].bitwiseAND(before.bitwiseOR(bit)) == 0, lambda c: c["n"]).alias("kept"),
        total(removed, lambda c: c["n"]).alias("removed"),
        total(lambda c: fails(c) & ~present(c), lambda c: c["n"]).alias("redundant"),
        total(lambda c: c["mask"] == bit, lambda c: c["n"]).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (F.lit(every) / c["fails"]).cast("long")).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return orders(cells(masks(docs), labels))


ORACLE = r"""
with docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as first from docs),
fails as (
  select doc_id, part, (len(w) < 200)::int as a, (100 * len(list_distinct(w)) < 50 * len(w))::int as b,
    (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int as c,
    regexp_matches(text, '[#$%&*|]')::int as d, coalesce(doc_id > first, false)::int as e
  from words),
flags as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
failing as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    list_filter([if(a = 1, 'A', ''), if(b = 1, 'B', ''), if(c = 1, 'C', ''), if(d = 1, 'D', ''), if(e = 1, 'E', '')], lambda x: x <> '') as failed
  from fails left join flags using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select [x1.l, x2.l, x3.l, x4.l, x5.l] as o from letters x1, letters x2, letters x3, letters x4, letters x5
  where len(list_distinct([x1.l, x2.l, x3.l, x4.l, x5.l])) = 5),
kinds as (select part, failed, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failing group by part, failed),
stepped as (select k.*, o, unnest([1, 2, 3, 4, 5]) as step from kinds k, orders),
state as (select *, o[step] as f, list_has_any(failed, o[1:step - 1]) as gone from stepped),
first_of as (select part, o[step] as f, sum(n) as shapley from state where not gone and list_contains(failed, f) group by all)
select s.part, array_to_string(o, '') as filter_order, step::int as step,
  coalesce(sum(n) filter (not gone and not list_contains(failed, s.f)), 0)::bigint as kept,
  coalesce(sum(n) filter (not gone and list_contains(failed, s.f)), 0)::bigint as removed,
  coalesce(sum(n) filter (gone and list_contains(failed, s.f)), 0)::bigint as redundant,
  coalesce(sum(n) filter (failed = [s.f]), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (not gone and list_contains(failed, s.f)), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (not gone and list_contains(failed, s.f)), 0)::bigint as toxic_lost,
  coalesce(any_value(shapley), 0)::bigint as shapley
from state s left join first_of r on s.part = r.part and s.f = r.f
group by s.part, o, step
"""
