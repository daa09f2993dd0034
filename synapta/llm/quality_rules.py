"""Line-first cleaning: rules judge each line, failed lines go, and a document that loses too much of itself is rejected."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from synapta.llm.common import NOT_SPACE, SPACES, map_batches, table

SYMBOLS = "#*$%&|<>"
#: Phrases of licence, cookie and sharing lines in English, German, French and Spanish. Such lines go; they rarely make up a document.
BOILERPLATE = (
    "all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|"
    "accept (all )?cookies|click here|subscribe (now|to our)|sign up for our|share (this|on) |enable javascript|lorem ipsum|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|hier klicken|newsletter abonnieren|"
    "tous droits réservés|politique de confidentialité|accepter les cookies|cliquez ici|abonnez-vous|"
    "todos los derechos reservados|política de privacidad|aceptar (las )?cookies|haga clic aquí|suscríbete"
)
#: Words that separate menu entries.
SEPARATORS = "|»·•>/"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 50
MIN_UNPUNCTUATED = 12

_boilerplate = re.compile(f"(?i){BOILERPLATE}")
#: The longest part of each phrase without a choice in it: a text that holds none of them, in lower case, has no such phrase.
STEMS = [max(re.split(r"\([^)]*\)\??", x), key=len) for x in re.split(r"\|(?![^(]*\))", BOILERPLATE)]
#: Letters that the pattern takes for i and s but that lower() leaves as they are.
LIKE = (("\u0131", "i"), ("\u017f", "s"))
_punctuation = re.compile(r"""[.!?;:,"'…。！？]""")


def may_hold_phrase(text: str) -> bool:
    folded = text.lower()
    for a, b in LIKE:
        if a in folded:
            folded = folded.replace(a, b)
    return any(stem in folded for stem in STEMS)


def bad_line(line: str, phrases: bool = True) -> tuple[int, bool]:
    """(words, whether the line fails a rule). A line without words has none and stays. ``phrases``: whether its text may hold one.

    Punctuation: more than one symbol character for two words; at least three words and half of all ending in '!!';
    12 words or more without any punctuation mark. Navigation: at least two separator words that are a quarter of all.
    Boilerplate: a listed phrase, or at least six words of which more than half repeat the word before.
    """
    words = line.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return 0, False
    symbols = sum(map(line.count, SYMBOLS))
    if 2 * symbols > n:
        return n, True
    if "!!" in line and (k := sum(w.endswith(b"!!") for w in words)) >= 3 and 2 * k >= n:
        return n, True
    if n >= MIN_UNPUNCTUATED and not _punctuation.search(line):
        return n, True
    separators = sum(w.decode("utf-8", "surrogatepass") in SEPARATORS for w in words if len(w) <= 3)
    if separators >= 2 and 4 * separators >= n:
        return n, True
    if n >= 6 and 2 * sum(map(bytes.__eq__, words, words[1:])) > n:
        return n, True
    return n, phrases and _boilerplate.search(line) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    pair = at[:-2] * m + at[1:-1]
    if m > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
        m = n
    code = pair * m + at[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


OUT = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_bad_lines", pa.int64()), ("n_words_lost", pa.int64()), ("clean_text", pa.string()),
]


def judge(text: str | None) -> tuple:
    """All output columns but the id for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = text.split("\n")
    phrases = may_hold_phrase(text)
    judged = [bad_line(x, phrases) for x in lines]
    with_words = [x for x, (k, _) in zip(lines, judged) if k]
    lost = sum(k for k, bad in judged if bad)
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    clean = "\n".join(x for x, (_, bad) in zip(lines, judged) if not bad) if lost else text
    chars = len(text) - sum(map(text.count, SPACES))
    return (
        n, chars, sum(map(text.count, SYMBOLS)), len(with_words) - len(set(with_words)), repeat, failed,
        not failed and 100 * lost <= MAX_LOST_PERCENT * n, sum(bad for _, bad in judged), lost, clean,
    )


def clean_lines(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base statistics, verdict and, if asked for, the text without failed lines.

    A null or empty text has no words: all counts 0, base_failed true, kept false, clean_text ''. Repeated rows and null
    ids are judged each; other columns are ignored. A very long text is judged whole; an empty table gives no rows. Narrow: no shuffle,
    memory bounded by a batch of texts.
    """
    fields = OUT if with_text else OUT[:-1]

    def run(batches):
        for b in batches:
            rows = list(zip(*map(judge, b.column("text").to_pylist())))
            cols = [b.column("doc_id"), *(pa.array(rows[i] if rows else [], t) for i, (_, t) in enumerate(fields[1:]))]
            yield pa.RecordBatch.from_arrays(cols, names=[k for k, _ in fields])

    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string"}
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return map_batches(rows, run, ", ".join(f"{k} {kinds[t]}" for k, t in fields))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"), with_text=False)


_W = f"regexp_extract_all({{}}, '{NOT_SPACE}')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_W.format("text")} AS ws FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 4),
keyed AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n >= 2),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, {_W.format("line")} AS ws FROM lines),
lf AS (
  SELECT r, line, len(ws) AS n, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sym,
    len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS bang,
    len(list_filter(ws, lambda x: x IN ('|', '»', '·', '•', '>', '/'))) AS sep,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS same
  FROM lw WHERE len(ws) > 0),
lb AS (
  SELECT *, (2 * sym > n OR (bang >= 3 AND 2 * bang >= n) OR (sep >= 2 AND 4 * sep >= n) OR (n >= 6 AND 2 * same > n)
    OR (n >= {MIN_UNPUNCTUATED} AND NOT regexp_matches(line, '[.!?;:,"''…。！？]'))
    OR regexp_matches(line, '(?i){BOILERPLATE}')) AS bad FROM lf),
la AS (SELECT r, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE bad) AS n_bad,
  coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM lb GROUP BY r),
j AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_bad, 0) AS n_bad_lines, coalesce(lost, 0) AS n_words_lost
  FROM w LEFT JOIN rep USING (r) LEFT JOIN la USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * n_words_lost <= {MAX_LOST_PERCENT} * n_words AS kept,
  CAST(n_bad_lines AS BIGINT) AS n_bad_lines, CAST(n_words_lost AS BIGINT) AS n_words_lost
FROM j
"""
