"""Problem 8: text quality statistics per document, and what shape of text a document is.

Method. The sender's own text is taken out of the raw message; patterns serve for that alone. Distributions of function words and of
character classes are then compared with prose profiles by Jensen-Shannon divergence, at two levels. Each line takes the kind (sentence,
item, row of cells, unreadable) of the nearest line profile (terrane.llm.structure). A text has the shares of its lines' kinds, the share of
function words, and its character classes; its distance to each structural profile is the sum of the three divergences, where the profile
expects function words and classes as its sentences (in the language whose ranked function words are nearest), items, cells and
unreadable lines have them. The nearest profile names the form.

One pass over the texts, without a shuffle, by array operations over the lines of many texts at once; the common words are a bounded table
that is sent to the workers as a parameter.

Defined results for dirty input: a null or empty text, or a message without a body of its own, has zero counts and the form
``none``; texts of any length are read whole; a common word without a rank comes after the ranked ones; repeated rows give repeated results;
extra columns are ignored; more common words of one language than ``MAX_WORDS_PER_LANGUAGE`` are an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from terrane.llm import structure
from terrane.llm.mail import own_text

#: The lists are sent to every worker; a longer one than this is an error.
MAX_WORDS_PER_LANGUAGE = 100_000
FORMS = ("prose", "list", "table", "junk")
#: Weights of the divergences of function words and of character classes beside that of the line kinds.
WORD_WEIGHT, CLASS_WEIGHT = 1.0, 0.2
#: Texts are taken in steps of so many characters, or one alone.
STEP_CHARS = 4_000_000
# shares of (sentence, item, cells, unreadable) lines
PROFILES = (
    ("prose", (0.94, 0.04, 0.01, 0.01)),
    ("prose", (0.60, 0.38, 0.01, 0.01)),
    ("prose", (0.60, 0.01, 0.38, 0.01)),
    ("prose", (0.60, 0.01, 0.01, 0.38)),
    ("prose", (0.30, 0.68, 0.01, 0.01)),
    ("prose", (0.30, 0.01, 0.68, 0.01)),
    ("prose", (0.30, 0.01, 0.01, 0.68)),
    ("list", (0.02, 0.94, 0.02, 0.02)),
    ("list", (0.15, 0.83, 0.01, 0.01)),
    ("list", (0.02, 0.70, 0.26, 0.02)),
    ("table", (0.02, 0.02, 0.94, 0.02)),
    ("table", (0.15, 0.01, 0.83, 0.01)),
    ("table", (0.02, 0.26, 0.70, 0.02)),
    ("junk", (0.02, 0.02, 0.02, 0.94)),
    ("junk", (0.15, 0.01, 0.01, 0.83)),
    ("junk", (0.02, 0.28, 0.02, 0.68)),
)
#: Share of running words of prose that are among a language's common words.
PROSE_COMMON = 0.42
#: The same for a sentence, an item, a row of cells and an unreadable line.
KIND_COMMON = (PROSE_COMMON, 0.04, 0.02, 0.02)
# fixed values: shares of the classes of ``structure.CLASSES`` in prose by language, per mille, measured on the texts labelled prose
# in the sample data (437 at most)
PROSE_CLASSES = {
    "": (763, 26, 3, 1, 12, 173, 0, 11, 10, 0, 1, 1, 0),
    "de": (766, 42, 0, 0, 12, 153, 1, 11, 14, 0, 0, 1, 0),
    "en": (767, 25, 0, 0, 12, 176, 0, 10, 8, 0, 1, 1, 0),
    "es": (763, 22, 0, 0, 19, 167, 3, 14, 11, 0, 0, 2, 0),
    "fr": (773, 18, 0, 0, 10, 171, 0, 10, 16, 0, 0, 0, 0),
    "ja": (83, 12, 558, 233, 42, 6, 0, 43, 21, 0, 0, 0, 0),
    "ru": (734, 24, 0, 0, 21, 167, 0, 19, 31, 1, 0, 2, 0),
}

# fixed values: how letters of the archive's languages open and close
_HELLO = re.compile(r"^(?:hi|hello|hey|dear|good (?:morning|day)|hallo|liebe[rs]?|guten|moin|servus|bonjour|salut|chers?|chère|hola|estimad[oa]s?|buenas|buenos|привет|здравствуйте|добрый|уважаем\w*|皆さん|こんにちは)\b", re.I)
_BYE = re.compile(r"^(?:best(?: regards| wishes)?|regards|kind regards|cheers|thanks(?: a lot| again)?|thank you|bye|yours|lg|mfg|vg|viele grüße|beste grüße|liebe grüße|grüße|gruß|danke|cordialement|amicalement|merci|bien à vous|à bientôt|bonne journée|saludos|un saludo|un abrazo|gracias|atentamente|abrazos|с уважением|спасибо|всего доброго|よろしくお願いします)\s*[,!.]*\s*$", re.I)
_STOPS = re.compile(r"[.!?。！？]+(?=[\"')\]»”’]*(?:\s|$))|[。！？]+")
_CLOSERS = "\"')]»”’ \t"
_ENDS = frozenset(".!?…:。！？")


def divergence(p, q) -> float:
    """Jensen-Shannon divergence in bits of two distributions."""
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a > 0:
            total += a / 2 * math.log2(a / m)
        if b > 0:
            total += b / 2 * math.log2(b / m)
    return total


class Profiles:
    """Function words of all languages and, per language, the weights that prose gives them."""

    def __init__(self, words: list[tuple[str, str, int]]):
        by_language: dict[str, list[tuple[int, str]]] = {}
        for language, word, rank in words:
            if language and word:
                by_language.setdefault(language, []).append((rank if rank and rank > 0 else 1 << 40, word.lower()))
        if any(len(ranked) > MAX_WORDS_PER_LANGUAGE for ranked in by_language.values()):
            raise ValueError("more common words than the workers are sent")
        self.languages = sorted(by_language)
        vocabulary = sorted({w for ranked in by_language.values() for _, w in ranked})
        self.code = {w: k for k, w in enumerate(vocabulary)}
        self.common = frozenset(vocabulary)
        self.weights = np.zeros((len(self.languages), len(vocabulary)))
        for k, language in enumerate(self.languages):
            ranked = list(dict.fromkeys(w for _, w in sorted(by_language[language])))
            whole = sum(1 / (r + 2) for r in range(len(ranked)))
            for r, word in enumerate(ranked):
                self.weights[k, self.code[word]] = PROSE_COMMON / (r + 2) / whole
        self.line_kinds, self.line_profiles = structure.example_profiles(self.common)
        classes = len(structure.CLASSES)
        of_kind = [self.line_profiles[self.line_kinds == k][:, :classes].mean(axis=0) for k in range(4)]
        prose = np.array(list(PROSE_CLASSES.values()))
        self.class_names = list(PROSE_CLASSES)
        self.prose_classes = prose / prose.sum(axis=1, keepdims=True)
        self.other_classes = np.array(of_kind[1:])
        self.shares = np.array([p for _, p in PROFILES])

    def nearest(self, text: np.ndarray, word: list[str], n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, divergence) of each text from the function words ``word`` of the texts ``text``; -1 where none is near."""
        n = len(n_words)
        language, best = np.full(n, -1), np.ones(n)
        if not len(self.languages):
            return language, best
        pairs, counts = np.unique(text * len(self.code) + np.fromiter((self.code[w] for w in word), np.int64, len(word)), return_counts=True)
        owner, code = np.divmod(pairs, len(self.code))
        share = counts / n_words[owner]
        for k in range(len(self.languages)):
            expected = self.weights[k][code]
            mine = expected > 0
            o, a, b = owner[mine], share[mine], expected[mine]
            m = (a + b) / 2
            total = np.bincount(o, a / 2 * np.log2(a / m) + b / 2 * np.log2(b / m), minlength=n)
            total = total.astype(float)
            spare = np.maximum(PROSE_COMMON - np.bincount(o, b, minlength=n), 0)
            left, other = np.maximum(1 - np.bincount(o, a, minlength=n), 0), 1 - PROSE_COMMON
            m = (left + other) / 2
            total += left / 2 * np.log2(np.maximum(left, 1e-12) / m) + other / 2 * np.log2(other / m) + spare / 2
            better = (total < best) & (n_words > 0)
            language[better], best[better] = k, total[better]
        return language, best


def _bare(lines: list[str]) -> tuple[int, int]:
    """Where the lines begin and end without opening and closing formulas."""
    first = int(bool(lines) and len(lines[0]) <= 60 and bool(_HELLO.match(lines[0].strip())) and len(lines[0].split()) <= 6)
    for back in (1, 2):
        if len(lines) - first >= back and _BYE.match(lines[-back].strip()) and all(len(x.split()) <= 3 for x in lines[len(lines) - back + 1 :]):
            return first, len(lines) - back
    return first, len(lines)


SENTENCE, ITEM, CELLS, UNREADABLE, RULE = range(5)


def _lead(kinds: np.ndarray, lines: list[str]) -> int:
    """How many lines at the top are one introducing sentence, which is left aside before lines of other kinds."""
    others = np.flatnonzero(kinds[:5] != SENTENCE)
    lead = int(others[0]) if len(others) else 0
    rest = len(kinds) - lead
    if 0 < lead <= 4 and rest >= 3 and (kinds[lead:] == SENTENCE).sum() <= 0.1 * rest and len(_STOPS.findall(" ".join(x.strip() for x in lines[:lead]))) <= 1:
        return lead
    return 0


def _js(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence over the last axis."""
    m = (p + q) / 2
    term = lambda x: np.where(x > 0, x * np.log2(np.maximum(x, 1e-12) / np.maximum(m, 1e-12)), 0.0)
    return (term(p) + term(q)).sum(axis=-1) / 2


COLUMNS = (
    "n_body_chars bigint, n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, punctuated_lines double, common_words double, "
    "nearest_language string, word_divergence double, class_divergence double, sentence_share double, item_share double, cell_share double, unreadable_share double, form string"
)
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def statistics(texts: list[str | None], profiles: Profiles) -> pd.DataFrame:
    """``COLUMNS`` of raw messages."""
    bodies = [own_text(t) for t in texts]
    steps, size = [[]], 0
    for body in bodies:
        if steps[-1] and size + len(body) > STEP_CHARS:
            steps.append([])
            size = 0
        steps[-1].append(body)
        size += len(body)
    return pd.concat([_measured(step, profiles) for step in steps], ignore_index=True)


def _measured(bodies: list[str], profiles: Profiles) -> pd.DataFrame:
    n = len(bodies)
    every = [[line.rstrip() for line in body.split("\n") if line.strip()] for body in bodies]
    lines = structure.Lines(every, profiles.common)
    kinds = profiles.line_kinds[structure.distances(lines.rows, profiles.line_profiles).argmin(axis=1)] if len(lines.text_of) else np.zeros(0, dtype=int)
    kept = np.zeros(len(kinds), dtype=bool)
    at = 0
    for own in every:
        first, last = _bare(own)
        first += _lead(kinds[at + first : at + last], own[first:last])
        kept[at + first : at + last] = True
        at += len(own)
    bodied = np.bincount(lines.text_of[kept], minlength=n) > 0
    owner, kinds = lines.text_of[kept], kinds[kept]
    weight = np.minimum(lines.lengths[kept], 80) + 20.0
    totals = np.bincount(owner * 5 + kinds, weight, minlength=n * 5).reshape(n, 5).astype(float)  # without any line it counts in integers
    rules, totals = totals[:, RULE], totals[:, :4].copy()
    only_rules = (totals.sum(axis=1) == 0) | (rules > 0.6 * (rules + totals.sum(axis=1)))
    totals[:, UNREADABLE] += np.where(only_rules, rules, 0.0)
    shares = totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-9)

    def summed(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(of, column, minlength=n) for column in np.atleast_2d(values.T)], axis=1)

    classes = summed(lines.classes[kept], owner)
    class_share = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
    words = np.bincount(owner, lines.n_words[kept], minlength=n)
    functions = np.bincount(owner, lines.n_function[kept], minlength=n)
    all_words = np.bincount(lines.text_of, lines.n_words, minlength=n)
    language, word_divergence = profiles.nearest(np.concatenate([t for t, _ in lines.function_words] or [np.zeros(0, int)]).astype(np.int64), [w for _, ws in lines.function_words for w in ws], all_words)
    kana = class_share[:, structure.CLASSES.index("kana")]
    names = [("ja" if k > 0.1 else profiles.languages[x] if x >= 0 else "") for x, k in zip(language, kana)]
    prose = profiles.prose_classes[[profiles.class_names.index(x) if x in PROSE_CLASSES else 0 for x in names]]
    # what each structural profile expects of a text in its language: function words and classes, mixed as its lines are
    common = functions / np.maximum(words, 1)
    common = np.where(kana > 0.1, np.maximum(common, PROSE_COMMON * shares[:, SENTENCE]), common)  # Japanese has no list of words
    expected = profiles.shares @ np.array(KIND_COMMON)
    by_words = _js(np.stack([common, 1 - common], axis=1)[:, None, :], np.stack([expected, 1 - expected], axis=1)[None, :, :])
    mixed = profiles.shares[None, :, :1] * prose[:, None, :] + (profiles.shares[:, 1:] @ profiles.other_classes)[None, :, :]
    by_classes = _js(class_share[:, None, :], mixed)
    distance = _js(shares[:, None, :], profiles.shares[None, :, :]) + WORD_WEIGHT * by_words + CLASS_WEIGHT * by_classes
    forms = np.array([form for form, _ in PROFILES], dtype=object)[distance.argmin(axis=1)]
    forms[~bodied] = "none"
    return pd.DataFrame(dict(zip(_NAMES, _counts(bodies, every, lines) + [names, word_divergence, np.where(bodied, _js(class_share, prose), 1.0), *shares.T, forms])))


def _counts(bodies: list[str], every: list[list[str]], lines: structure.Lines) -> list:
    n = len(bodies)
    of = lines.text_of
    by_class = {c: np.bincount(of, lines.classes[:, k], minlength=n) for k, c in enumerate(structure.CLASSES)}
    chars = np.maximum(sum(by_class.values()), 1)
    words = np.bincount(of, lines.n_words, minlength=n).astype(np.int64)
    n_lines = np.array([len(x) for x in every])
    ends = np.array([sum(x.rstrip(_CLOSERS)[-1:] in _ENDS for x in ls) for ls in every])
    symbols = sum(by_class[c] for c in ("stop", "pause", "bracket", "divider", "symbol", "broken"))
    return [
        np.array([len(b) for b in bodies]), n_lines, words, np.bincount(of, lines.word_chars, minlength=n) / np.maximum(words, 1), symbols / chars, by_class["digit"] / chars,
        ends / np.maximum(n_lines, 1), np.bincount(of, lines.n_common, minlength=n) / np.maximum(words, 1),
    ]


def text_statistics(documents: DataFrame, words: list[tuple[str, str, int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, and ``COLUMNS``) of every document; ``words`` are (language, word, rank)."""
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles(words)
        for frame in frames:
            if len(frame):
                made = statistics(frame[text].tolist(), profiles)
                made.insert(0, key, frame[key].to_numpy())
                yield made

    return documents.select(key, text).mapInPandas(run, f"`{key}` {kind}, {COLUMNS}")
