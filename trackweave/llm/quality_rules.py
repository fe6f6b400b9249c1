"""Quality rules, line first: each line is judged by its punctuation, navigation marks and boilerplate phrases; failing
lines are removed, and a document that loses too much of its text is rejected.

A line fails if it is short and has no terminal punctuation; is a chain of separators (bars, breadcrumbs) or of navigation words; is
shouted; is made of symbols; is short and a label with a list (`Tags: red, blue.`); or is short and holds a phrase of site furniture in English,
German, French or Spanish. Furniture without any of these is known by its place: four or more brief lines in a row at the head or the foot of
a document, before its first or after its last longer line, fail together, whatever they say, where they are a quarter of its words at most; so a
document of brief lines only has neither. A long line without terminal punctuation is prose that was cut, and stays.

Defined results: a null text has no words (all counts 0), so it fails the base rule and isn't kept; so does an empty text.
Lines are split at \n only; a line without a word never fails and never counts as a repeated line. Repeated rows give
repeated results. Other columns of the input, whatever their names, pass through `clean` unchanged."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackweave.llm.common import BLANKS, map_batches

SYMBOLS = "#*$%&|<>"
#: Characters that end a sentence, or close one that has ended.
TERMINAL = ".!?\u2026:;\"'\u201d\u201c\u2019\u00bb)]"
#: Words that only separate; bars are counted wherever they are.
SEPARATORS = (">", "\u00bb", "\u203a", "/", "\u00b7", "\u2022", "\u2192", "::")
#: What may surround a navigation word.
AROUND = ".,:;!?()[]{}\"'\u00bb\u00ab<>|/\u00b7\u2022\u2192-"
#: Phrases of site furniture, matched in lower case in lines of few words.
BOILERPLATE = (
    "accept all cookies", "we use cookies", "cookie policy", "cookie settings", "privacy policy", "terms of use", "terms of service",
    "terms and conditions", "all rights reserved", "copyright \u00a9", "copyright (c)", "copyright 19", "copyright 20", "\u00a9 19", "\u00a9 20",
    "sign in to continue", "log in to continue", "subscribe to our newsletter", "sign up for our newsletter", "enable javascript",
    "javascript must be enabled", "javascript is disabled", "click here to", "share on facebook", "share on twitter", "back to top", "skip to content",
    "alle rechte vorbehalten", "datenschutzerkl\u00e4rung", "nutzungsbedingungen", "gesch\u00e4ftsbedingungen", "wir verwenden cookies",
    "cookies akzeptieren", "newsletter abonnieren", "javascript aktivieren", "zum seitenanfang", "zum inhalt springen",
    "tous droits r\u00e9serv\u00e9s", "politique de confidentialit\u00e9", "mentions l\u00e9gales", "conditions d'utilisation", "nous utilisons des cookies",
    "accepter les cookies", "inscrivez-vous \u00e0 notre newsletter", "activer javascript", "retour en haut", "aller au contenu",
    "todos los derechos reservados", "pol\u00edtica de privacidad", "pol\u00edtica de cookies", "aviso legal", "condiciones de uso",
    "t\u00e9rminos y condiciones", "utilizamos cookies", "aceptar cookies", "suscr\u00edbete a nuestro bolet\u00edn", "habilitar javascript", "volver arriba", "ir al contenido",
)
#: Calls to follow a link, matched in lower case in lines of hardly more words than the call.
CALLS = ("read more", "learn more", "see more", "load more", "weiterlesen", "mehr erfahren", "mehr lesen", "lire la suite", "en savoir plus", "leer m\u00e1s", "ver m\u00e1s")
#: Words of menus and share bars, matched in lower case.
NAVIGATION = (
    "home", "login", "logout", "register", "help", "contact", "about", "search", "menu", "share", "tweet", "pin", "email", "print", "cart", "checkout",
    "account", "subscribe", "sitemap", "faq", "news", "blog", "products", "next", "previous", "facebook", "twitter", "instagram", "youtube", "linkedin", "rss",
    "startseite", "anmelden", "registrieren", "hilfe", "kontakt", "suche", "impressum", "datenschutz", "agb", "teilen", "drucken", "warenkorb",
    "accueil", "connexion", "inscription", "aide", "recherche", "partager", "imprimer", "panier", "suivant", "pr\u00e9c\u00e9dent",
    "inicio", "registro", "ayuda", "contacto", "buscar", "compartir", "carrito", "siguiente", "anterior",
)


@dataclass(frozen=True)
class LineRules:
    """Shares are in percent of a line's words; lines of at most `short_words` words are short; marks are separators or shouts."""

    short_words: int = 30
    least_marks: int = 2
    least_symbols: int = 3
    symbol_share: int = 50
    separator_share: int = 25
    shout_share: int = 25
    call_words: int = 5
    brief_words: int = 8
    block_lines: int = 4
    block_share: int = 25
    list_share: int = 40
    navigation_words: int = 8
    navigation_share: int = 60
    lost_share: int = 50
    min_words: int = 20
    repeat_share: int = 30


RULES = LineRules()
_MENU = frozenset(NAVIGATION)
_BETWEEN = frozenset(SEPARATORS)


@lru_cache(maxsize=1)
def phrases() -> ahocorasick.Automaton:
    """All phrases, each with whether it is a call."""
    out = ahocorasick.Automaton()
    for call, some in ((False, BOILERPLATE), (True, CALLS)):
        for phrase in some:
            out.add_word(phrase, call)
    out.make_automaton()
    return out


def line_fails(line: str, words: list[bytes], rules: LineRules = RULES) -> bool:
    """Whether a line of these words breaks a rule."""
    n = len(words)
    if n == 0:
        return False
    short = n <= rules.short_words
    if short and line.rstrip(" \t\n\x0b\x0c\r")[-1] not in TERMINAL:
        return True
    marks = line.count("|") + sum(w.decode() in _BETWEEN for w in words if len(w) <= 3)
    if marks >= rules.least_marks and marks * 100 >= rules.separator_share * n:
        return True
    shouts = line.count("!!")
    if shouts >= rules.least_marks and shouts * 100 >= rules.shout_share * n:
        return True
    symbols = sum(map(line.count, SYMBOLS))
    if symbols >= rules.least_symbols and symbols * 100 >= rules.symbol_share * n:
        return True
    if not short:
        return False
    label = next((k for k in (1, 2) if k <= n and words[k - 1].endswith(b":")), 0)
    listed = sum(w.endswith(b",") for w in words[label:])
    if label and listed >= 2 and listed * 100 >= rules.list_share * (n - label):
        return True
    if n <= rules.navigation_words:
        menu = sum(w.decode().lower().strip(AROUND) in _MENU for w in words)
        if menu >= 2 and menu * 100 >= rules.navigation_share * n:
            return True
    return any(not call or n <= rules.call_words for _, call in phrases().iter(line.lower()))


def furniture(counts: list[int], rules: LineRules = RULES) -> set[int]:
    """Of lines with so many words each, those of the blocks of brief lines at head and foot."""
    longer = [k for k, n in enumerate(counts) if n > rules.brief_words]
    if not longer:
        return set()
    ends = [k for k in range(longer[0]) if counts[k]], [k for k in range(longer[-1] + 1, len(counts)) if counts[k]]
    small = lambda block: 100 * sum(counts[k] for k in block) <= rules.block_share * sum(counts)
    return {k for block in ends if len(block) >= rules.block_lines and small(block) for k in block}


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words that the text has at least twice."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    mixed = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ ids[k : n - width + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # no equal hashes, so no equal windows
        return 0
    step = 1
    while step < width:  # exact numbers of windows of 2, 4 and 8 words
        _, ids = np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)
        step *= 2
    again = np.bincount(ids)[ids] > 1
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def judge(text: str | None, rules: LineRules = RULES) -> tuple[int, int, int, int, int, bool, bool, str | None, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text, lines removed)."""
    if text is None:
        return 0, 0, 0, 0, 0, True, False, None, 0
    words = text.encode().split()
    n = len(words)
    seen: set[str] = set()
    good: list[str] = []
    dup = lost = removed = 0
    lines = [(line, line.encode().split()) for line in text.split("\n")]
    blocks = furniture([len(here) for _, here in lines], rules)
    for k, (line, here) in enumerate(lines):
        if here:
            if line in seen:
                dup += 1
            else:
                seen.add(line)
        if k in blocks or line_fails(line, here, rules):
            lost += len(here)
            removed += 1
        else:
            good.append(line)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.repeat_share * n
    kept = not failed and 100 * lost <= rules.lost_share * n
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, failed, kept, "\n".join(good) if removed else text, removed


def score(docs: DataFrame, rules: LineRules = RULES) -> DataFrame:
    """Counts and verdicts for each document: one row each, with the cleaned text's length and digest left out."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, texts = batch.columns
        rows = [judge(t, rules) for t in texts.to_pylist()]
        cols = list(zip(*rows))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        return {"doc_id": ids} | dict(zip(names, cols)) | {"n_lines_removed": cols[8]}

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long", run)


def clean(docs: DataFrame, rules: LineRules = RULES) -> DataFrame:
    """The documents that pass, with their failing lines removed and n_chars set to the new length where lines went."""
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(t, rules) for t in batch.column(at).to_pylist()]
        keep = pa.array([r[6] for r in rows], pa.bool_())
        cols = list(batch.columns)
        cols[at] = pa.array([r[7] for r in rows], cols[at].type)
        if size >= 0:
            cols[size] = pa.array([len(r[7]) if r[8] else old for r, old in zip(rows, cols[size].to_pylist())], cols[size].type)
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(keep)

    return map_batches(docs, docs.schema, run)


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pattern(values: tuple[str, ...]) -> str:
    return "|".join(re.escape(v).replace("'", "''") for v in values)


#: The same in SQL: lines and words are unnested, windows of eight words counted per document.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
ls AS (SELECT *, regexp_extract_all(line, '[^{BLANKS}]+') AS ws FROM l),
lm AS (SELECT rid, line, pos, len(ws) AS words,
  right(regexp_replace(line, '[{BLANKS}]+$', ''), 1) AS ending,
  length(line) - length(replace(line, '|', '')) + len(list_filter(ws, lambda w: w IN ({_quoted(SEPARATORS)}))) AS marks,
  (length(line) - length(replace(line, '!!', ''))) // 2 AS shouts,
  length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
  len(list_filter(ws, lambda w: trim(lower(w), {_quoted((AROUND,))}) IN ({_quoted(NAVIGATION)}))) AS menu,
  regexp_matches(lower(line), '{_pattern(BOILERPLATE)}') AS phrase, regexp_matches(lower(line), '{_pattern(CALLS)}') AS call,
  CASE WHEN ends_with(ws[1], ':') THEN 1 WHEN ends_with(ws[2], ':') THEN 2 ELSE 0 END AS label,
  row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth, ws FROM ls),
lb AS (SELECT *, min(pos) FILTER (words > 8) OVER (PARTITION BY rid) AS first_long, max(pos) FILTER (words > 8) OVER (PARTITION BY rid) AS last_long,
  len(list_filter(ws[label + 1 :], lambda w: ends_with(w, ','))) AS listed FROM lm),
bl AS (SELECT *, count(*) FILTER (words > 0 AND pos < first_long) OVER r AS head, count(*) FILTER (words > 0 AND pos > last_long) OVER r AS foot, sum(words) OVER r AS all_words,
  coalesce(sum(words) FILTER (pos < first_long) OVER r, 0) AS head_words, coalesce(sum(words) FILTER (pos > last_long) OVER r, 0) AS foot_words FROM lb WINDOW r AS (PARTITION BY rid)),
lf AS (SELECT *, words > 0 AND ((pos < first_long AND head >= 4 AND 100 * head_words <= 25 * all_words) OR (pos > last_long AND foot >= 4 AND 100 * foot_words <= 25 * all_words)
  OR (words <= 30 AND label > 0 AND listed >= 2 AND listed * 100 >= 40 * (words - label)) OR ((words <= 30 AND ending NOT IN ({_quoted(tuple(TERMINAL))}))
  OR (marks >= 2 AND marks * 100 >= 25 * words) OR (shouts >= 2 AND shouts * 100 >= 25 * words) OR (symbols >= 3 AND symbols * 100 >= 50 * words)
  OR (words <= 8 AND menu >= 2 AND menu * 100 >= 60 * words) OR (words <= 30 AND phrase) OR (words <= 5 AND call))) AS fails FROM bl),
la AS (SELECT rid, sum(words) AS n_words, count(*) FILTER (WHERE words > 0 AND nth > 1) AS n_dup_lines,
  coalesce(sum(words) FILTER (WHERE fails), 0) AS lost, count(*) FILTER (WHERE fails) AS removed FROM lf GROUP BY rid),
w AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT rid, regexp_extract_all(t, '[^{BLANKS}]+') AS ws FROM d)),
g AS (SELECT rid, pos, count(*) OVER last8 AS k, string_agg(word, ' ') OVER last8 AS win FROM w
  WINDOW last8 AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS c FROM g WHERE k = 8) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(pos - 7, pos + 1)) AS p FROM r) GROUP BY rid)
SELECT d.doc_id, CAST(n_words AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[{BLANKS}]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(c.n, 0) > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * coalesce(c.n, 0) > 30 * n_words) AND 100 * lost <= 50 * n_words AS kept,
  CAST(removed AS BIGINT) AS n_lines_removed
FROM d JOIN la USING (rid) LEFT JOIN c USING (rid)
"""
