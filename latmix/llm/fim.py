"""Fill-in-the-middle: texts are cut at two drawn places and their pieces are put in another order.

A text becomes an array of code points (UTF-32). Units are runs of code points of one class: the
classes of neighbours are compared, and where they differ a unit ends. Two of the places so found are
chosen by rank: the prefix ends at the one, the middle at the other. What is drawn follows from the id
alone (SHA-256 of ``seed:id``), so reruns and partitionings agree.

Forms: ``plain`` leaves the text as it is; ``psm`` is prefix, suffix, middle, each after its mark;
``spm`` is suffix, prefix, middle. A text that is empty or holds a mark is plain, so what was made can
be undone: ``restore`` needs the output and its form only.

Null texts count as empty, texts of any length are cut whole, one at a time. A null id draws as an
empty one. Repeated rows and ids draw alike and stay rows of their own. An empty table: no rows.
Columns that are not named are left out, whatever they are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lean, table, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut; of 100 that are cut so many are spm.
CUT, SPM, SEED = 90, 20, 1
ROWS = "form string, prefix_chars long, middle_chars long, output string"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def classes(x: np.ndarray, unit: str) -> np.ndarray:
    """What neighbours of one unit have in common."""
    if unit == "char":
        return np.arange(len(x)) & 1
    if unit == "word":  # words and what lies between them
        return (x == 32) | ((x >= 9) & (x <= 13))
    if unit == "line":  # a line break ends its line
        return np.append(0, np.cumsum(x == 10)[:-1]) & 1 if len(x) else x
    raise ValueError(f"no such unit: {unit}")


def boundaries(x: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and where the last one ends: one more than there are units."""
    c = classes(x, unit)
    inner = np.flatnonzero(c[1:] != c[:-1]) + 1
    return np.concatenate([np.zeros(1, np.int64), inner, np.full(min(len(x), 1), len(x))])


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight digits of the hash, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def pieces(text: str, first: int, second: int, unit: str) -> tuple[str, str, str]:
    """Prefix, middle and suffix; the places are the draws modulo how many there are."""
    x = code_points(text)
    ends = boundaries(x, unit)
    a, b = sorted((int(ends[first % len(ends)]), int(ends[second % len(ends)])))
    back = lambda part: part.tobytes().decode("utf-32-le")
    return back(x[:a]), back(x[a:b]), back(x[b:])


def _cut(keep: int, unit: str, cut: int, spm: int):
    marks = (PREFIX, SUFFIX, MIDDLE)

    def one(text, h1, h2, h3, h4):
        if not text or any(m in text for m in marks) or h3 % 100 >= cut:
            return "plain", None, None, text
        p, m, s = pieces(text, h1, h2, unit)
        form = "spm" if h4 % 100 < spm else "psm"
        out = f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}" if form == "spm" else f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"
        return form, len(p), len(m), out

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            h = [batch.column(keep + 1 + k).to_numpy() for k in range(4)]
            done = [one(batch.column(keep)[i].as_py(), *(int(c[i]) for c in h)) for i in range(batch.num_rows)]
            made = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *made], names=[*batch.schema.names[:keep], *(f.split()[0] for f in ROWS.split(", "))])

    return run


def transform(docs: DataFrame, *keep: str, key: str = "doc_id", unit: str = "char", cut: int = CUT, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """docs' columns ``keep``, then form, prefix_chars and middle_chars (null if plain) and output."""
    names = [f"_keep{k}" for k in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(keep, names)), text_or_empty().alias("_text"), *(d.alias(f"_draw{k}") for k, d in enumerate(draws(F.col(key), seed))))
    fields = [f"{a} {rows.schema[a].dataType.simpleString()}" for a in names]
    made = rows.mapInArrow(lean(_cut(len(keep), unit, cut, spm)), ", ".join([*fields, ROWS]))
    return made.select(*(F.col(a).alias(c) for c, a in zip(keep, names)), *(f.split()[0] for f in ROWS.split(", ")))


def restore(output: Column, form: Column) -> Column:
    """The text, from the output and its form."""
    s, m = F.instr(output, SUFFIX), F.instr(output, MIDDLE)
    p = F.instr(output, PREFIX)
    part = lambda mark, begin, stop: output.substr(begin + len(mark), stop - begin - len(mark))
    end = F.length(output) + 1
    psm = F.concat(part(PREFIX, p, s), part(MIDDLE, m, end), part(SUFFIX, s, m))
    spm = F.concat(part(PREFIX, p, m), part(MIDDLE, m, end), part(SUFFIX, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length(text_or_empty()).cast("long").alias("n"))
    made = transform(docs, "doc_id", "n")
    back = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {CUT} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

QUERIES = {"op11_fim": op11_fim}
ORACLE = {"op11_fim": _ORACLE}
