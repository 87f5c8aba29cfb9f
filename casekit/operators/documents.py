"""Documents -> overlapping chunks -> term vectors -> context text.

Chunking, fixed and boundary-aware, and the tokens of the term vectors are
native expressions (regular expressions, ``split``/``md5``, higher-order array
functions), with no Python worker and no shuffle.  Every text is processed whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.parallel import spread
from casekit.functions.workers import ship_with_tasks

ship_with_tasks(__name__)

# ---------------------------------------------------------------------------
# These must stay equal to the reference for equal results.
# ---------------------------------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
TOP_K = 3
CONTEXT_SEPARATOR = "\n\n"
# ---------------------------------------------------------------------------

# Cut preference for boundary mode: blank line, line, word, anywhere.
BOUNDARY_SEPARATORS = ["\n\n", "\n", " ", ""]


# --------------------------------------------------------------- D1 fixed --
def chunk_documents(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fixed character chunks: starts 0, size-overlap, ...; the last chunk
    ends at the text end and no chunk lies wholly inside the previous one.

    Output ``(id, chunk_id, start, chunk_text)``; ``start`` is 0-based.
    Empty or null texts give no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.length(F.col(text_col))
    # One pass cuts the text into pieces of ``step`` characters; a chunk is the
    # first ``size`` characters of a few pieces in a row.  Only pieces go on.
    rows = spread(df.filter(n > 0)).select(
        F.col(id_col), F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("__p"),
        F.ceil(F.greatest(n - overlap, F.lit(1)) / step).cast("int").alias("__n"))
    rows = rows.select(id_col, F.inline_outer(F.array(F.struct("__p", "__n"))))  # cut once per text

    def chunk(i: Column) -> Column:
        return F.left(F.concat(*[F.coalesce(F.get(F.col("__p"), i + k), F.lit("")) for k in range(-(-size // step))]), F.lit(size))

    texts = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), chunk)
    return (rows.select(id_col, F.posexplode(texts).alias("chunk_id", "chunk_text"))
                .select(id_col, "chunk_id", (F.col("chunk_id") * step).alias("start"), "chunk_text"))


# ------------------------------------------------------------ D1 boundary --
def _atoms(text: str, lo: int, hi: int, seps: list[str], size: int) -> list[tuple[int, int]]:
    """Split [lo, hi) at the first separator kind present until every span
    fits ``size``; a separator stays with the span before it."""
    if hi - lo <= size:
        return [(lo, hi)]
    for i, sep in enumerate(seps):
        if sep == "":
            return [(s, min(s + size, hi)) for s in range(lo, hi, size)]
        pos = text.find(sep, lo, hi)
        if pos < 0:
            continue
        spans, start = [], lo
        while pos >= 0:
            end = pos + len(sep)
            spans.append((start, end))
            start = end
            pos = text.find(sep, end, hi)
        if start < hi:
            spans.append((start, hi))
        out: list[tuple[int, int]] = []
        for a, b in spans:
            out.extend(_atoms(text, a, b, seps[i + 1:], size))
        return out
    return [(lo, hi)]


def boundary_spans(text: str | None, size: int, overlap: int) -> list[list[int]]:
    """Greedy merge of separator-aligned spans into chunks of at most
    ``size`` characters; consecutive chunks share at most ``overlap``."""
    if not text:
        return []
    atoms = _atoms(text, 0, len(text), BOUNDARY_SEPARATORS, size)
    chunks, first, cur_len = [], 0, 0
    for i, (a, b) in enumerate(atoms):
        span = b - a
        if i > first and cur_len + span > size:
            chunks.append([atoms[first][0], atoms[i - 1][1]])
            while first < i and (cur_len > overlap or cur_len + span > size):
                cur_len -= atoms[first][1] - atoms[first][0]
                first += 1
        cur_len += span
    if atoms:
        chunks.append([atoms[first][0], atoms[-1][1]])
    # Whitespace-only chunks carry no text.
    return [c for c in chunks if text[c[0]:c[1]].strip()]


# What str.strip() takes away, as a character class.
_BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _separated(text: Column, size: int) -> Column:
    """Spans of a text between separators, as an array of strings: what is
    longer than ``size`` is split behind blank lines, then line breaks, then
    spaces, then anywhere."""
    def cut(spans: Column, pattern: str) -> Column:
        return F.flatten(F.transform(spans, lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(
            F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))))

    spans = F.array(text)
    for sep in BOUNDARY_SEPARATORS:
        spans = cut(spans, f"(?s).*?{sep}|.+" if sep else f"(?s).{{1,{size}}}")
    return spans


def _merged(spans: Column, size: int, overlap: int) -> Column:
    """Chunks as (first span, end span, start): a fold over the spans.

    The state holds where the open chunk begins, where it ends so far, and the
    places at its end that the next chunk can begin at (``overlap`` characters
    of them, so it stays small however long the text).
    """
    place = lambda i, at: F.struct(i.alias("i"), at.alias("at"))
    chunk = lambda first, end: F.struct(first["i"].alias("first"), end.alias("end"), first["at"].alias("start"))
    zero = F.lit(0)
    state = F.struct(place(zero, zero).alias("first"), place(zero, zero).alias("end"),
                     F.array().cast("array<struct<i:int,at:int>>").alias("next"),
                     F.array().cast("array<struct<first:int,end:int,start:int>>").alias("out"))

    def add(x: Column, span: Column) -> Column:
        first, end, n = x["first"], x["end"], F.length(span)
        full = (end["i"] > first["i"]) & (end["at"] + n - first["at"] > size)
        fits = F.filter(x["next"], lambda p: end["at"] - p["at"] <= F.least(F.lit(overlap), size - n))
        begin = F.when(full, F.coalesce(F.get(fits, zero), end)).otherwise(first)
        then = F.filter(F.array_append(x["next"], end), lambda p: (p["i"] >= begin["i"]) & (end["at"] + n - p["at"] <= overlap))
        return F.struct(begin.alias("first"), place(end["i"] + 1, end["at"] + n).alias("end"), then.alias("next"),
                        F.when(full, F.array_append(x["out"], chunk(first, end["i"]))).otherwise(x["out"]).alias("out"))

    return F.aggregate(spans, state, add, lambda x: F.array_append(x["out"], chunk(x["first"], x["end"]["i"])))


def chunk_documents_boundary(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks cut at a blank line, else a line break, else a space, else
    anywhere; same output shape as :func:`chunk_documents`.  Consecutive chunks
    share at most ``overlap`` characters; chunks of white space only are left
    out.  Native expressions; :func:`boundary_spans` states the same cut.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    rows = spread(df.filter(F.length(F.col(text_col)) > 0)).select(F.col(id_col), _separated(F.col(text_col), size).alias("__s"))
    rows = rows.select(id_col, F.inline_outer(F.array(F.struct("__s"))))  # split once per text
    rows = rows.select(id_col, F.inline_outer(F.array(F.struct("__s", _merged(F.col("__s"), size, overlap).alias("__c")))))
    texts = F.transform("__c", lambda c: F.struct(c["start"].alias("start"), F.array_join(
        F.slice("__s", c["first"] + 1, c["end"] - c["first"]), "").alias("chunk_text")))
    rows = rows.select(id_col, F.inline_outer(F.array(F.struct(texts.alias("__t")))))
    said = F.filter("__t", lambda t: t["chunk_text"].rlike(f"[^{_BLANK}]"))
    return rows.select(id_col, F.posexplode(said).alias("chunk_id", "p")).select(id_col, "chunk_id", "p.start", "p.chunk_text")


CHUNKERS = {"fixed": chunk_documents, "boundary": chunk_documents_boundary}


# --------------------------------------------------------------------- D2 --
def terms(text: Column) -> Column:
    """Lower-cased tokens: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_buckets(text: Column, dims: int) -> Column:
    """Tokens (:func:`terms`) mapped to ``dims`` buckets by the first 32 bits of
    their md5 (stable across engines and runs)."""
    if not 1 <= dims <= 1 << 31:
        raise ValueError("dims must be in 1..2**31")
    return F.transform(terms(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dims)


def _histogram_udf(dims: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def histogram(buckets: pd.Series) -> pd.Series:
        # One bincount per Arrow batch: row r, bucket b -> cell r*dims + b.
        lens = buckets.map(lambda a: 0 if a is None else len(a)).to_numpy()
        flat = (np.concatenate([a for a in buckets if a is not None and len(a)])
                if lens.sum() else np.zeros(0, dtype=np.int64)).astype(np.int64)
        rows = np.repeat(np.arange(len(buckets)), lens)
        counts = np.bincount(rows * dims + flat, minlength=len(buckets) * dims)
        counts = counts.reshape(len(buckets), dims).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1))
        vecs = np.divide(counts, norms[:, None], out=counts.copy(), where=norms[:, None] > 0)
        return pd.Series(list(vecs))
    return histogram


def hashed_term_vector(text: Column, dims: int = 64) -> Column:
    """L2-normalised term-count vector (array<double>, length ``dims``).

    Tokenising and hashing run JVM-side; Spark has no array histogram, so
    the counting and normalising of the bucket ids is one vectorised numpy
    ``bincount`` per Arrow batch (a per-dimension ``filter`` would cost
    tokens x dims interpreted lambda calls per text).
    """
    return _histogram_udf(dims)(term_buckets(text, dims))


def vectorize_chunks(chunks: DataFrame, dims: int = 64, text_col: str = "chunk_text",
                     out: str = "vector") -> DataFrame:
    return chunks.withColumn(out, hashed_term_vector(F.col(text_col), dims))


# --------------------------------------------------------------------- T2 --
def assemble_context(ranked: DataFrame, query_id: str = "query_id", rank: str = "rank",
                     text_col: str = "chunk_text", sep: str = CONTEXT_SEPARATOR,
                     also: list[Column] | None = None) -> DataFrame:
    """Best chunks per query joined by a blank line, best first, and further
    aggregates over ``__best`` rows if wanted.  Groups hold at most k rows
    (the output of a top-k), so the list is bounded."""
    best = F.array_sort(F.collect_list(F.struct(F.col(rank), *[F.col(c) for c in ranked.columns if c not in (query_id, rank)])))
    rows = ranked.groupBy(query_id).agg(best.alias("__best"))
    return rows.select(query_id, F.array_join(F.transform("__best", lambda x: x[text_col]), sep).alias("context"), *(also or []))
