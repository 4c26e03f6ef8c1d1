"""Line dedup: winnowed runs of lines that repeat earlier ones.

Every line with a word is hashed. Of each window of ``gram`` consecutive lines'
k-grams the least is a fingerprint, so a repeated run of ``run`` lines shares one.
A fingerprint's occurrences are joined with its first one and matches extended
both ways; windows of lines that the first occurrence cannot explain meet again
by their whole content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rows import packed, replaced, unpacked
from .storage import materialize
from .words import SPACE, grams, mix

RUN, GRAM = 3, 2


def line_hashes(documents: DataFrame) -> DataFrame:
    """(doc_id, key, h): hashes of the lines with a word, in order."""
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return documents.select("doc_id", "key", F.transform(worded, lambda x: F.xxhash64(x)).alias("h"))


def _winnow(run: int, gram: int):
    """Rows (print, doc_id, key, place, context): each fingerprint's place in its
    document, and the hashes of the ``run - 1`` lines before it, its own and those
    behind (0 where there is none)."""
    span = run - gram + 1

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = run - gram
        for b in batches:
            ids, keys, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            flat = np.asarray(pc.list_flatten(lists), np.int64).view(np.uint64)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            ends = np.cumsum(size)
            out: list[tuple] = []
            for i in np.flatnonzero(size >= run).tolist():
                h = flat[ends[i] - size[i] : ends[i]]
                g = grams(h, gram, seed=9)
                value = np.lib.stride_tricks.sliding_window_view(mix(g), span)
                picked = np.unique(np.arange(len(value)) + value.argmin(1))
                padded = np.concatenate([np.zeros(reach, np.uint64), h, np.zeros(reach, np.uint64)])
                for p in picked.tolist():
                    out.append((int(g[p].view(np.int64)), ids[i], keys[i], p, padded[p : p + gram + 2 * reach].view(np.int64)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["print", "doc_id", "key", "place", "context"])

    return f


def repeated_lines(hashed: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, place, size): intervals of worded lines of ``hashed`` (see
    ``line_hashes``, each document once) that repeat a run of ``run`` lines at least which starts at an earlier (doc_id, place)."""
    reach = run - gram
    prints = hashed.mapInArrow(_winnow(run, gram), "print long, doc_id long, key long, place int, context array<long>")
    prints = materialize(prints, "line-prints")
    place = F.struct("doc_id", "place", "key")
    firsts = prints.groupBy("print").agg(F.min(F.struct("doc_id", "place", "key", "context")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = prints.join(firsts.select("print", "first"), "print")
    # extension both ways against the first occurrence, as far as a run can reach
    same = lambda i: F.get("context", i) == F.get("first.context", i)
    there = lambda i: F.get("context", i) != 0
    back, ahead = F.lit(0), F.lit(0)
    for k in range(reach, 0, -1):
        steps = [same(F.lit(reach - j)) & there(F.lit(reach - j)) for j in range(1, k + 1)]
        back = F.when(_all(steps) & (back == 0), k).otherwise(back)
        steps = [same(F.lit(reach + gram - 1 + j)) & there(F.lit(reach + gram - 1 + j)) for j in range(1, k + 1)]
        ahead = F.when(_all(steps) & (ahead == 0), k).otherwise(ahead)
    core = _all([same(F.lit(reach + j)) for j in range(gram)])
    met = met.select("print", "doc_id", "key", "place", "context", "first", F.when(core, back).otherwise(-1).alias("back"), F.when(core, ahead).otherwise(-1).alias("ahead"))
    later = (F.col("doc_id") > F.col("first.doc_id")) | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("place") > F.col("first.place")))
    long_ = F.col("back") + F.col("ahead") + gram >= run
    done = met.filter(later & (F.col("back") >= 0) & long_).select("doc_id", "key", (F.col("place") - F.col("back")).alias("place"), (F.col("back") + F.col("ahead") + gram).alias("size"))
    # windows around the fingerprint that differ from the first occurrence's
    offsets = F.sequence(F.lit(0), F.lit(reach))
    windows = F.filter(offsets, lambda o: F.forall(F.slice("context", o + 1, run), lambda h: h != 0) & (F.slice("context", o + 1, run) != F.slice("first.context", o + 1, run)))
    open_ = met.select("doc_id", "key", "place", "context", F.explode(windows).alias("o"))
    open_ = open_.select("doc_id", "key", (F.col("place") - F.lit(reach) + F.col("o")).alias("place"), F.slice("context", F.col("o") + 1, run).alias("lines"))
    open_ = materialize(open_.select("doc_id", "key", "place", F.xxhash64("lines").alias("w"), F.xxhash64(F.reverse("lines")).alias("v")).distinct(), "line-windows")
    first = open_.groupBy("w", "v").agg(F.min(F.struct("doc_id", "place")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    rest = open_.join(first, ["w", "v"]).filter(F.struct("doc_id", "place") > F.col("f")).select("doc_id", "key", "place", F.lit(run).alias("size"))
    return done.unionByName(rest)


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _dedup(documents: DataFrame, run: int, gram: int, doc_id: str, text: str) -> DataFrame:
    """(row, text, n_lines, n_removed, kept_text); the text moves in ``row`` alone."""
    base = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), packed(documents))
    read = base.select("doc_id", "key", F.col("row").getField(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    gone = repeated_lines(line_hashes(read).dropDuplicates(["doc_id", "key"]), run, gram)
    gone = gone.groupBy("doc_id", "key").agg(F.collect_set(F.struct("place", "size")).alias("gone"))
    # texts move once at every size: few enough lines to broadcast would make a plan of small tables only
    joined = base.join(materialize(gone, "line-gone").hint("merge"), ["doc_id", "key"], "left")
    # removed worded lines by number, then the text's lines with those numbers out
    numbers = F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["place"], g["place"] + g["size"] - 1))))
    joined = joined.select("row", F.col("row").getField(text).alias("text"), F.sort_array(numbers).alias("out"))
    lines = F.split("text", "\n")
    worded = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, worded))).cast("long").alias("n_lines")
    removed = F.when(F.col("out").isNull(), F.lit(0)).otherwise(F.size("out")).cast("long").alias("n_removed")
    # texts that lose nothing do not enter the function
    asked = F.when(F.col("out").isNotNull(), F.col("text"))
    cut = joined.select("row", "text", total, removed, F.pandas_udf(_without, StringType())(asked, F.col("out")).alias("cut"))
    return cut.select("row", "text", "n_lines", "n_removed", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("cut")).alias("kept_text"))


def dedup_lines(documents: DataFrame, run: int = RUN, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with n_lines, n_removed and kept_text.

    Lines are split at \\n; those with a word count. A line goes if it is in a run
    of ``run`` such lines that also starts at an earlier place: in a document with
    a smaller id, or further up in the same one. Lines without a word stay where
    they are. Texts with fewer lines, null texts (0 lines, kept_text null) and
    rows with a null id stay as they are; rows that repeat an id are distinct
    documents of equal rank, and neither removes the other's lines. Ids must be
    whole numbers, or text of them. Other columns stay; one with the name of an
    added column gives way to it. Lines are compared by 64-bit hashes, runs by
    several of them.
    """
    return _dedup(documents, run, gram, doc_id, text).select(*unpacked(documents.columns, "n_lines", "n_removed", "kept_text"))


def _without(texts: pd.Series, outs: pd.Series) -> pd.Series:
    blank = bytes(np.flatnonzero(SPACE).tolist())

    def one(text, out):
        if text is None or out is None:
            return text
        gone, n, kept = set(out), 0, []
        for line in text.split("\n"):
            if line.encode().strip(blank):
                if n not in gone:
                    kept.append(line)
                n += 1
            else:
                kept.append(line)
        return "\n".join(kept)

    return pd.Series([one(t, o) for t, o in zip(texts, outs, strict=True)], dtype=object)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the kept text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without lines that repeat, alone or in runs; n_chars follows."""
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return _dedup(docs, 1, 1, "doc_id", "text").select(*replaced(docs.columns, **new))


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM t),
x AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS worded FROM l),
n AS (SELECT rid, doc_id, i, line, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS p FROM x WHERE worded),
w AS (SELECT rid, doc_id, p, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c FROM n WINDOW o AS (PARTITION BY rid ORDER BY p)),
r AS (SELECT rid, doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE c IS NOT NULL),
g AS (SELECT DISTINCT rid, p + d AS p FROM r, (VALUES (0), (1), (2)) v(d) WHERE k > 1),
m AS (SELECT x.rid, x.i, x.line, x.worded, g.p IS NOT NULL AS gone FROM x LEFT JOIN n ON x.rid = n.rid AND x.i = n.i LEFT JOIN g ON n.rid = g.rid AND n.p = g.p),
s AS (SELECT rid, CAST(count(*) FILTER (WHERE worded) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM t JOIN s USING (rid)"""
