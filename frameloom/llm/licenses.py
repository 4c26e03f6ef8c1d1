"""License scans: canonical digests of texts, lines and blocks against known licences.

A line is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings); the forms of its lines make that of a block or text. Its
SHA-256 is looked up among the digests of known licence texts by a hash join.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import slices

#: Licence identifiers and notice texts.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
]
#: Licences whose complete text is in license_texts/, with the title that may stand above it.
COMPLETE = {"MIT": "MIT License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Apache-2.0": "", "GPL-2.0-only": "", "GPL-3.0-only": "", "LGPL-2.1-only": "", "LGPL-3.0-only": "", "MPL-2.0": "", "CC0-1.0": ""}
#: Spellings that mean the same.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("v2", "version 2"), ("v3", "version 3"), ("organisation", "organization"), ("noncommercial", "non commercial"), ("analog", "analogue"), ("whilst", "while"), ("http", "https")]
COPYRIGHT = re.compile(r"[ \t\r>*#/;-]*(?:copyright|\(c\)|©|all rights reserved)".encode(), re.IGNORECASE)
#: A-Z to lower case, other ASCII than letters and digits to blanks.
FOLD = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SAME = {a.encode(): b.encode() for a, b in SPELLINGS}


def line_form(line: bytes) -> bytes:
    """Canonical form of one line; empty if it has no word or is a copyright line."""
    if COPYRIGHT.match(line):
        return b""
    words = line.translate(FOLD).split(b" ")
    if not SAME.keys().isdisjoint(words):
        words = [SAME.get(w, w) for w in words]
    return b" ".join(filter(None, words))


def canonical(text: bytes) -> bytes:
    return b" ".join(filter(None, map(line_form, text.split(b"\n"))))


def _units(text: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(unit, number of its first line, canonical form)."""
    lines = text.split(b"\n")
    forms = [line_form(x) for x in lines]
    join = lambda part: b" ".join(filter(None, part))
    yield "text", 0, join(forms)
    for i, f in enumerate(forms):
        yield "line", i + 1, f
    blocks, begin = [], None
    for i, x in enumerate([*lines, b""]):
        if x.strip(b" \t\r"):
            begin = i if begin is None else begin
        elif begin is not None:
            blocks.append((begin, i))
            begin = None
    if len(blocks) > 1:  # one block alone has the form of the whole text
        for a, b in blocks:
            if b > a + 1:  # those of one line are lines already
                yield "block", a + 1, join(forms[a:b])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches, "text"):
        row, unit, line, digest = [], [], [], []
        for i, t in enumerate(texts):
            for kind, number, form in _units(t):
                if form:
                    row.append(i)
                    unit.append(kind)
                    line.append(number)
                    digest.append(hashlib.sha256(form).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.array(row, np.int64))), pa.array(unit, pa.string()), pa.array(line, pa.int32()), pa.array(digest, pa.string())], names=["id", "unit", "line_no", "digest"])


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of licence texts (license_id, text); the first id of equal texts."""
    kind = known.schema["license_id"].dataType.simpleString()
    d = known.select(F.col("license_id").alias("id"), "text").filter("text IS NOT NULL").mapInArrow(_digests, f"id {kind}, unit string, line_no int, digest string")
    return d.filter("unit = 'text'").groupBy("digest").agg(F.min("id").alias("license_id"))


def license_scan(documents: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, unit, line_no, license_id, digest) for each match.

    Units are the whole text ('text', line_no 0), each line on its own ('line',
    from 1) and each block of two lines or more between blank lines ('block',
    with its first line's number), if the text has other blocks; a unit matches
    if its entire canonical form is a known text. A text of one line that matches
    gives both rows. Null or empty texts match nothing; a null id stays null and ids
    may be of any type; repeated rows match once each; other columns are not read.
    """
    d = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    u = d.mapInArrow(_digests, f"id {d.schema['id'].dataType.simpleString()}, unit string, line_no int, digest string")
    return u.join(F.broadcast(digests(known)), "digest").select(F.col("id").alias("doc_id"), "unit", "line_no", "license_id", "digest")


def known_notices(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in NOTICES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS k(license_id, text)")


def known_texts(spark: SparkSession) -> DataFrame:
    """The notices and the complete licences, these with and without their title."""
    rows = []
    for name, title in COMPLETE.items():
        body = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()
        rows += [(name, body)] + [(name, f"{title}\n\n{body}")] * bool(title)
    return known_notices(spark).unionByName(spark.createDataFrame(rows, "license_id string, text string"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs, known_texts(spark))


def _canonical_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?im)^[ \\t\\r>*#/;-]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g')"
    x = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    x = f"' ' || regexp_replace({x}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        x = f"replace({x}, ' {a} ', ' {b} ')"
    return f"trim({x}, ' ')"


SQL = f"""
WITH k AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(license_id) AS license_id
  FROM (VALUES {', '.join("('%s', '%s')" % x for x in NOTICES)}) v(license_id, text) GROUP BY 1),
u AS (SELECT doc_id, 0 AS line_no, text FROM documents UNION ALL
  SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER), unnest(l) FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
f AS (SELECT doc_id, line_no, {_canonical_sql('text')} AS form FROM u)
SELECT doc_id, CASE WHEN line_no = 0 THEN 'text' ELSE 'line' END AS unit, line_no, license_id, digest
FROM (SELECT *, sha256(form) AS digest FROM f WHERE form <> '') JOIN k USING (digest)"""
