"""Line-first quality rules, all in built-in functions.

Each line of a text is judged -- sentence punctuation, navigation separators,
symbol noise, shouting, stuttering, boilerplate -- and failing lines are
removed.  Only the punctuation rule looks at the lines around: a line that is
part of a hard-wrapped running sentence needs no sentence end of its own.  A
document that loses more than ``max_lost`` of its word
characters this way is rejected, as is one that fails the base rules (fewer
than ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PCT`` percent of its words
inside 8-word windows that occur twice or more).

Defined results: a null or empty text (or one of white space only) has no
words, all counts are 0, the cleaned text is empty and it fails the base
rules.  Rows are judged one by one, so repeated rows, ties and null ids give
one result each and an empty table gives an empty result.  Extra columns are
carried along; working columns start with ``_q_`` and are dropped.  Very long
texts cost time in proportion to their length (windows are compared as
hashes; positions of repeated ones are sorted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.common import GAP, HAS_WORD, sealed, text_of, words_of

# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30

# Line rules.
# Ends: also full width, danda, Arabic, Urdu, Armenian, Ethiopic, Khmer, Burmese, Tibetan, Mongolian.
_ENDS = (r"[.!?:;\x{2026}\x{3002}\x{ff01}\x{ff1f}\x{ff0e}\x{ff1a}\x{ff1b}\x{ff61}\x{0964}\x{0965}\x{061b}\x{061f}\x{06d4}"
         r"\x{0589}\x{1362}\x{1367}\x{17d4}\x{17d5}\x{104a}\x{104b}\x{0f0d}\x{0f0e}\x{1803}\x{1809}]"
         r"['\x22)\]\x{00bb}\x{2019}\x{201d}\x{300d}\x{300f}\x{ff09}]*")
# Scripts without spaces go on right after their ends.
SENTENCE_END = _ENDS + r"([\x20\x09-\x0D]|$)|[\x{3002}\x{ff01}\x{ff1f}\x{ff61}]"
LINE_ENDS_SENTENCE = _ENDS + r"[\x20\x09-\x0D]*$"
GOES_ON_LOWER = r"^[\x20\x09-\x0D]*['\x22(\[\x{00ab}\x{2018}\x{201c}]*\p{Ll}"
SEPARATORS = "[|»›•]"
NOISE = "[#*$%&<>~=_^]"
ANY_NOISE = "[|»›•#*$%&<>~=_^!]"
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|accept cookies|use of cookies|privacy policy|terms of use|"
    r"terms of service|click here|read more|sign up for|subscribe to|log in to|skip to content|"
    r"enable javascript|back to top|share this|lorem ipsum)"
)
BOILERPLATE_MAX_CHARS = 200
NOISE_MIN = 3          # so few symbols, separators or exclamation marks are never noise
NOISE_PER_CHARS = 20   # noise: one or more per so many characters of the line
# A line without any sentence end stays when it is prose by length: lists of
# links and headings are short.
UNPUNCTUATED_MIN_CHARS = 200
# A line that runs on into the next one is at least so long: wrapped lines end
# where the next word does not fit, single links and headings are shorter.
WRAPPED_MIN_CHARS = 30
# Lines are tested for stuttering where more than one in so many words of the
# document repeats the word before it.
STUTTER_ONE_IN = 20
# A word and its immediate repeats.
STUTTER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))+"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def _runs_on(lines: Column, i: Column) -> Column:
    """The sentence of line ``i`` runs on into the next line.

    The line ends open and is not all capitalized words, and the next one
    either goes on in lower case or, for nouns and scripts without case, begins
    with a word that did not fit: the line with that word would be longer than
    all lines around.  Half or more capitalized words then make it a title.
    """
    line, after = F.get(lines, i), F.get(lines, i + 1)
    first = F.length(F.element_at(F.split(F.regexp_replace(after, "^" + GAP, ""), GAP, 2), 1))
    width = F.greatest(*[F.length(F.get(lines, i + j)) for j in (-2, -1, 0, 1, 2)])
    titled = _count(F.regexp_replace(line, r"(?<=[^\x20\x09-\x0D])[^\x20\x09-\x0D]+", ""), r"\p{Lu}")
    n_words = F.size(words_of(line))
    wrapped = (F.length(line) + 1 + first > width) & (2 * titled < n_words)
    return F.coalesce((F.length(line) >= WRAPPED_MIN_CHARS) & after.rlike(HAS_WORD) & ~line.rlike(LINE_ENDS_SENTENCE)
                      & ((after.rlike(GOES_ON_LOWER) & (titled < n_words)) | wrapped), F.lit(False))


def line_verdicts(lines: Column, i: Column, stutters: Column) -> dict[str, Column]:
    """The line rules for line ``i`` of ``lines``: name -> true when it fails it.

    ``stutters`` says whether the whole document repeats words enough for the
    repetition rule to be looked at.
    """
    line = F.get(lines, i)
    n = F.length(line)

    def dense(chars: str) -> Column:
        c = _count(line, chars)
        return line.rlike(chars) & (c >= NOISE_MIN) & (c * NOISE_PER_CHARS > n)

    word_chars = F.length(F.regexp_replace(line, GAP, ""))
    fresh_chars = F.length(F.regexp_replace(F.regexp_replace(line, STUTTER, "$1"), GAP, ""))
    return {
        "punctuation": (n < UNPUNCTUATED_MIN_CHARS) & ~line.rlike(SENTENCE_END)
        & ~_runs_on(lines, i) & ~_runs_on(lines, i - 1),
        "navigation": dense(SEPARATORS),
        "symbols": dense(NOISE),
        "shouting": dense("!"),
        "repetition": stutters & (2 * fresh_chars < word_chars),
        "boilerplate": (n <= BOILERPLATE_MAX_CHARS) & line.rlike(BOILERPLATE),
    }


def line_fails(lines: Column, i: Column, stutters: Column) -> Column:
    v = line_verdicts(lines, i, stutters)
    noise = F.get(lines, i).rlike(ANY_NOISE) & (v["navigation"] | v["symbols"] | v["shouting"])  # one scan for most lines
    return v["punctuation"] | noise | v["repetition"] | v["boilerplate"]


def repeated_window_words(df: DataFrame, words: str, out: str, echo: str,
                          window: int = WINDOW) -> DataFrame:
    """Add ``out``: words covered by ``window``-word windows found twice or
    more, and ``echo``: words equal to the word before.

    Word hashes are folded pairwise into window hashes (2, 4, 8 words), so
    every array element is built once.  Only texts with a repeated hash go on:
    (hash, position) pairs are sorted, positions whose neighbour has the same
    hash are kept, and the lengths of their union summed.
    """
    assert window & (window - 1) == 0, "window must be a power of two"
    df = sealed(df, {"_q_h": F.transform(F.col(words), lambda w: F.xxhash64(w))})
    span = 1
    while span < window:
        # arr[i], arr[i + span] for every i that has both
        left = F.slice("_q_h", F.lit(1), F.greatest(F.size("_q_h") - span, F.lit(0)))
        right = F.slice("_q_h", F.lit(span + 1), F.greatest(F.size("_q_h") - span, F.lit(0)))
        new = {"_q_h": F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))}
        if span == 1:
            new[echo] = F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda x: x))
        df = sealed(df, new)
        span *= 2
    df = sealed(df, {"_q_s": F.when(
        F.size(F.array_distinct("_q_h")) < F.size("_q_h"),
        F.array_sort(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))})
    s = F.col("_q_s")
    same = lambda x, j: (
        (x["h"] == F.get(s, j - 1)["h"]).eqNullSafe(F.lit(True))
        | (x["h"] == F.get(s, j + 1)["h"]).eqNullSafe(F.lit(True)))
    df = sealed(df, {"_q_p": F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))})
    p = F.col("_q_p")
    steps = F.transform(p, lambda a, j: F.least(F.coalesce(F.get(p, j + 1) - a, F.lit(window)), F.lit(window)))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return sealed(df, {out: F.coalesce(total, F.lit(0).cast("long"))}).drop("_q_h", "_q_s", "_q_p")


def quality_rules(df: DataFrame, text_col: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Append the counts, ``clean_text``, ``base_failed`` and ``kept``.

    ``lost_chars`` counts word characters in removed lines.
    """
    df = sealed(df, {"_q_t": text_of(text_col)})
    t = F.col("_q_t")
    df = sealed(df, {
        "_q_w": words_of(t),
        "_q_a": F.split(t, "\n"),
        "n_symbols": _count(t, SYMBOLS).cast("long"),
    })
    df = sealed(df, {"_q_l": F.filter("_q_a", lambda x: x.rlike(HAS_WORD))})
    df = repeated_window_words(df, "_q_w", "n_repeat_words", "_q_echo")
    stutters = F.col("_q_echo") * STUTTER_ONE_IN > F.size("_q_w")
    df = sealed(df, {
        "n_words": F.size("_q_w").cast("long"),
        "word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "n_dup_lines": (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"),
        "_q_c": F.filter("_q_a", lambda x, i: x.rlike(HAS_WORD) & ~line_fails(F.col("_q_a"), i, stutters)),
        "_q_n": F.size("_q_l"),
    }).drop("_q_t", "_q_w", "_q_a", "_q_l", "_q_echo")
    clean = F.array_join("_q_c", "\n")
    df = sealed(df, {"clean_text": clean, "lost_chars": F.when(F.size("_q_c") == F.col("_q_n"), F.lit(0)).otherwise(
        F.col("word_chars") - F.length(F.regexp_replace(clean, GAP, ""))).cast("long")}).drop("_q_c", "_q_n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    kept = ~failed & (F.col("lost_chars") <= F.lit(max_lost) * F.col("word_chars"))
    return df.withColumn("base_failed", failed).withColumn("kept", kept)


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "lost_chars", "base_failed", "kept"]
DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
          "lost_chars", "kept"]


def oracle_sql(max_lost: float = 0.5) -> str:
    """DuckDB rendering of the registered query, written out independently."""
    closing = r"[.!?:;…。！？．：；｡।॥؛؟۔։።፧។៕၊။།༎᠃᠉][''\x22)\]»’”」』）]*"
    end = closing + r"([\x20\x09-\x0D]|$)|[。！？｡]"
    gap = r"[\x20\x09-\x0D]+"
    word = r"[^\x20\x09-\x0D]"
    lw = f"list_filter(regexp_split_to_array(l, '{gap}'), lambda x: x <> '')"
    # every word but those equal to the word before, against every word
    fresh = (f"list_sum(list_transform(list_zip({lw}, list_prepend('', {lw})), "
             "lambda p: CASE WHEN p[1] = p[2] OR p[1] IS NULL THEN 0 ELSE len(p[1]) END))")
    phrases = BOILERPLATE
    def count(c: str) -> str:
        return f"(len(l) - len(regexp_replace(l, '{c}', '', 'g')))"

    def dense(c: str) -> str:
        return f"({count(c)} >= 3 AND {count(c)} * 20 > len(l))"
    bad = (f"((NOT regexp_matches(l, '{end}') AND len(l) < 200 AND NOT runs AND NOT coalesce(before, false)) OR {dense('[|»›•]')} OR {dense('[#*$%&<>~=_^]')} "
           f"OR {dense('!')} OR (echo * 20 > len(w) AND 2 * {fresh} < len(regexp_replace(l, '{gap}', '', 'g'))) OR (len(l) <= 200 AND regexp_matches(l, '{phrases}')))")
    # A line runs on into the next: it is long, ends open, and is no title; the
    # next goes on in lower case, or starts with a word that did not fit.
    titled = f"len(list_filter({lw}, lambda x: regexp_matches(x, '^\\p{{Lu}}')))"
    lower = r"^[\x20\x09-\x0D]*[''\x22(\[«‘“]*\p{Ll}"
    first = f"len(regexp_extract(nxt, '{word}+'))"
    near = ", ".join(f"length(lag(l, {k}) OVER lines), length(lead(l, {k}) OVER lines)" for k in (1, 2))
    runs = (f"coalesce(len(l) >= 30 AND regexp_matches(nxt, '{word}') AND NOT regexp_matches(l, '{closing}[\\x20\\x09-\\x0D]*$') AND "
            f"((regexp_matches(nxt, '{lower}') AND {titled} < len({lw})) OR (len(l) + 1 + {first} > width AND 2 * {titled} < len({lw}))), false)")
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{gap}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
e AS (
  SELECT r, len(list_filter(list_zip(w, list_prepend('', w)), lambda p: p[1] = p[2])) AS echo FROM d),
lines AS (
  SELECT r, j, l, lead(l) OVER lines AS nxt, greatest(length(l), {near}) AS width
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS j FROM d)
  WINDOW lines AS (PARTITION BY r ORDER BY j)),
lost AS (
  SELECT r, sum(len(regexp_replace(l, '{gap}', '', 'g'))) AS n
  FROM (SELECT *, lag(runs) OVER (PARTITION BY r ORDER BY j) AS before FROM (SELECT *, {runs} AS runs FROM lines)) JOIN d USING (r) JOIN e USING (r)
  WHERE regexp_matches(l, '{word}') AND {bad} GROUP BY r),
win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c >= 2),
cov AS (
  SELECT r, count(DISTINCT p) AS n
  FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         len(regexp_replace(t, '{gap}', '', 'g'))::BIGINT AS word_chars,
         (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN lost USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, lost_chars,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= {max_lost} * word_chars AS kept
FROM base"""
