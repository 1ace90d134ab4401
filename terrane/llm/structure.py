"""Structural profiles: lines of text as distributions, compared with profiles of sentences, items, rows of cells and unreadable data.

Each line is four distributions: its character classes, its words (function words of any language, other words by length, repeated
words), the transitions between vowels and consonants inside its words, and its shape (how it opens and ends, how many words, whether it
is divided like the other lines of its text). The distance of two lines is the weighted sum of the Jensen-Shannon divergences of the
four. A profile is the mean of the lines of a short written example, made by the same code; a line takes the kind of the nearest one.

Everything is counted by array operations over the lines of many texts at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

KINDS = ("sentence", "item", "cells", "unreadable", "rule")
CLASSES = ("lower", "upper", "kana", "uncased", "digit", "space", "gap", "stop", "pause", "bracket", "divider", "symbol", "broken")
WORDS = ("function", "short", "middle", "long", "overlong", "repeated", "none")
TURNS = ("alternating", "consonants", "vowels", "none")
SHAPE = ("mark", "capital", "small", "figure", "other", "full stop", "pause", "letter", "end symbol", "1", "2", "3-4", "5-7", "8-12", "13+", "divided", "undivided")
#: Weights of the four divergences.
WEIGHTS = (1.0, 1.0, 0.7, 1.3)
_EDGES = np.cumsum([0, len(CLASSES), len(WORDS), len(TURNS), len(SHAPE)])
#: Characters whose lines are counted in one step; longer texts are counted in several.
STEP_CHARS = 1_000_000

# fixed values: the vowels of the alphabets met
_VOWELS = "aeiouyäöüáéíóúàèìòùâêîôûëïãõåæøœаеёиоуыэюя"
_MARKS = "-*•+·–‣◦#"


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point of the basic plane and whether it is a vowel; what lies beyond counts as a symbol."""
    named = {c: k for k, c in enumerate(CLASSES)}
    table = np.full(0x10000, named["symbol"], dtype=np.uint8)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            kind = "kana" if 0x3040 <= code < 0x3100 else "lower" if c.islower() else "upper" if c.isupper() else "uncased"
        elif c.isdigit():
            kind = "digit"
        elif c == "\t":
            kind = "gap"
        elif c.isspace():
            kind = "space"
        elif code < 32 or 0x7F <= code < 0xA0 or code == 0xFFFD or 0xD800 <= code < 0xE000:
            kind = "broken"
        else:
            continue
        table[code] = named[kind]
    for chars, kind in ((".!?。！？…", "stop"), (",:'\"-、：’“”„«»", "pause"), ("()[]", "bracket"), ("|;", "divider")):
        for c in chars:
            table[ord(c)] = named[kind]
    vowels = np.zeros(0x10000, dtype=bool)
    for c in _VOWELS + _VOWELS.upper():
        vowels[ord(c)] = True
    return table, vowels


_TABLE, _IS_VOWEL = _class_table()
_LOWER, _UPPER, _KANA, _UNCASED, _DIGIT, _SPACE, _GAP, _STOP, _PAUSE, _BRACKET, _DIVIDER, _SYMBOL, _BROKEN = range(len(CLASSES))


class Lines:
    """Counts of lines: ``classes`` by line, ``n_words``, ``n_common``, ``n_function``, ``word_chars``, and the distributions side by side in ``rows``."""

    def __init__(self, texts: list[list[str]], common: frozenset):
        lines = [line for text in texts for line in text]
        self.text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        n = len(lines)
        self.classes = np.zeros((n, len(CLASSES)), dtype=np.float32)
        words = np.zeros((n, len(WORDS)), dtype=np.float32)
        turns = np.zeros((n, len(TURNS)), dtype=np.float32)
        shape = np.zeros((n, len(SHAPE)), dtype=np.float32)
        self.n_words = np.zeros(n, dtype=np.int64)
        self.n_common, self.n_function = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)  # with and without single letters
        self.word_chars = np.zeros(n, dtype=np.int64)
        self.function_words: list[tuple[np.ndarray, np.ndarray]] = []  # (text, word) of each function word
        at = 0
        while at < n:
            until = at + 1
            size = self.lengths[at]
            while until < n and size + self.lengths[until] < STEP_CHARS:
                size += self.lengths[until]
                until += 1
            self._count(lines[at:until], slice(at, until), common, words, turns, shape)
            at = until
        self._dividers(lines, texts, shape)
        words[:, -1] = words.sum(axis=1) == 0
        turns[:, -1] = turns.sum(axis=1) == 0
        self.rows = np.concatenate([_shares(self.classes), _shares(words), _shares(turns), shape / 4], axis=1)

    def _count(self, lines: list[str], part: slice, common: frozenset, words: np.ndarray, turns: np.ndarray, shape: np.ndarray) -> None:
        text = "\n".join(lines) + "\n"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(codes, 0xFFFF).astype(np.uint16)
        kinds = _TABLE[small]
        newline = codes == 10
        owner = np.cumsum(newline) - newline
        k, n = len(CLASSES), len(lines)
        two = (kinds == _SPACE) & ~newline
        wide = np.zeros_like(two)
        wide[1:] = two[1:] & two[:-1]
        first = np.zeros(n, dtype=np.int64)
        last = np.flatnonzero(newline) - 1
        first[1:] = last[:-1] + 2
        kinds = np.where(wide, _GAP, kinds)
        keep = ~newline
        self.classes[part] = np.bincount(owner[keep] * k + kinds[keep], minlength=n * k).reshape(n, k)
        letter = kinds <= _UNCASED
        edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = ends - starts
        line = owner[starts]
        small_letters = text.lower()
        if len(small_letters) != len(text):  # a few capitals have two small letters
            small_letters = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        word, known = pd.factorize(np.array([small_letters[a:b] for a, b in zip(starts.tolist(), ends.tolist())], dtype=object))
        is_function = np.fromiter((w in common for w in known), bool, len(known))[word] if len(known) else np.zeros(0, dtype=bool)
        single = size == 1  # single letters are as often marks as words
        base = int(part.start)
        self.n_words[part] = np.bincount(line, minlength=n)
        self.n_common[part] = np.bincount(line, weights=is_function, minlength=n)
        self.function_words.append((self.text_of[part][line[is_function]], np.asarray(known, dtype=object)[word[is_function]]))
        is_function &= ~single
        self.n_function[part] = np.bincount(line, weights=is_function, minlength=n)
        self.word_chars[part] = np.bincount(line, weights=size, minlength=n)
        bins = np.where(is_function, 0, np.select([size <= 3, size <= 9, size <= 15], [1, 2, 3], 4))
        # runs of kana are words and endings in one: half of them counts as function words
        kana = kinds[starts] == _KANA
        bins = np.where(kana, 0, bins)
        again = pd.Series(line * (len(known) + 1) + word).duplicated().to_numpy()
        bins = np.where(again & ~is_function & ~kana, 5, bins)
        use = ~single
        words[part] += np.bincount(line[use] * len(WORDS) + bins[use], minlength=n * len(WORDS)).reshape(n, -1)
        pair = letter[1:] & letter[:-1] & (kinds[1:] < _KANA) & (kinds[:-1] < _KANA)
        v = _IS_VOWEL[small]
        turn = np.where(v[1:] != v[:-1], 0, np.where(v[1:], 2, 1))[pair]
        turns[part] += np.bincount(owner[:-1][pair] * len(TURNS) + turn, minlength=n * len(TURNS)).reshape(n, -1)
        opened = np.fromiter((_opening(x) for x in lines), np.int64, n)
        shape[np.arange(base, base + n), opened] = 1
        final = kinds[last]
        closed = np.select([final == _STOP, (final == _PAUSE) | (final == _DIVIDER), (final <= _DIGIT)], [5, 6, 7], 8)
        shape[np.arange(base, base + n), closed] = 1
        amount = np.select([self.n_words[part] <= 1, self.n_words[part] == 2, self.n_words[part] <= 4, self.n_words[part] <= 7, self.n_words[part] <= 12], [9, 10, 11, 12, 13], 14)
        shape[np.arange(base, base + n), amount] = 1

    def _dividers(self, lines: list[str], texts: list[list[str]], shape: np.ndarray) -> None:
        """Whether a line is divided as often, by the same divider, as most lines of its text."""
        at = 0
        for text in texts:
            n = len(text)
            if n:
                shape[at : at + n, 15] = divided(text)
            at += n
        shape[:, 16] = 1 - shape[:, 15]


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _opening(line: str) -> int:
    """How a line opens: with a list's mark, a capital, a small letter, a figure or something else."""
    bare = line.lstrip()
    c = bare[0]
    if c.isalpha():
        return 0 if bare[1:3] in (") ", ". ") else 1 if c.isupper() else 2
    if c in _MARKS:
        return 0 if bare[1:2].isspace() or (c == "#" and bare[1:2].isdigit()) else 4
    if c in "[(" and bare[2:3] in "])":
        return 0
    if c.isdigit():
        rest = bare.lstrip("0123456789")
        return 0 if rest[:2] in (". ", ") ") and len(bare) - len(rest) <= 4 else 3
    return 4


def divided(lines: list[str]) -> np.ndarray:
    """For each line the degree, 0 to 1, to which it is divided like the other lines of its text."""
    n = len(lines)
    best, degree = 0.0, np.zeros(n)
    ends_alike = next((c for c in ",;" if sum(x.endswith(c) for x in lines) >= 0.9 * n - 1), "") if n > 2 else ""
    for mark in ("|", "\t", ";", ",", "  "):
        if mark == "  ":
            counts = np.array([len([p for p in x.strip().split("  ") if p.strip()]) - 1 for x in lines])
        elif mark == "|":
            counts = np.array([x.strip().strip("|").count(mark) for x in lines])
        else:
            counts = np.array([x.count(mark) - (mark == ends_alike and x.endswith(mark)) for x in lines])
        some = counts[counts > 0]
        if len(some) < 2:
            continue
        if mark == "  ":  # an empty cell joins two gaps, so the counts need not agree
            alike = counts > 0
        else:
            usual = np.bincount(some).argmax()
            if usual < 2 and mark in ",;":
                continue
            alike = counts >= usual
        share = alike.sum() / n
        if share > best and share >= 0.5:
            best, degree = share, alike * share
    return degree


#: Shares are rounded to this part where logarithms are looked up.
_PARTS = 1 << 11
_X_LOG_X = np.arange(2 * _PARTS + 1) / (2 * _PARTS)
_X_LOG_X = (_X_LOG_X * np.log2(np.maximum(_X_LOG_X, 1e-12))).astype(np.float32)


def distances(rows: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Weighted sums of Jensen-Shannon divergences of each row to each profile."""
    weight = np.repeat(np.array(WEIGHTS, dtype=np.float32), np.diff(_EDGES))
    rows, profiles = np.rint(rows * _PARTS).astype(np.uint16), np.rint(profiles * _PARTS).astype(np.uint16)
    theirs = _X_LOG_X[2 * profiles] @ weight / 2
    out = np.empty((len(rows), len(profiles)), dtype=np.float32)
    for at in range(0, len(rows), 4096):
        some = rows[at : at + 4096]
        own = _X_LOG_X[2 * some] @ weight / 2
        for k, profile in enumerate(profiles):
            out[at : at + 4096, k] = own + theirs[k] - _X_LOG_X.take(some + profile) @ weight
    return out


# written examples of each kind of line, one profile each
EXAMPLES = (
    ("sentence", "The bridge near the old mill was closed last week, and nobody has told us why.\nWe had to walk around the lake to get to the other side of it.\nI think that it will be open again before the end of the month."),
    ("sentence", "which is not what they had in mind when this was planned, so the whole\nthing has to be done again from the start, and it takes an hour or two on\nthe machine that we have at home. Can you tell me what to do about it"),
    ("sentence", "Thanks for the answer.\nThat is all I have for now.\nDoes it work for you?"),
    ("sentence", "Please look at 12 of the 345 entries in list_a.csv; after the change it needs about 67 minutes, which is less than before (see https://a.example/b)."),
    ("sentence", "Der Weg am See ist seit einer Woche gesperrt, und das hat uns niemand gesagt.\nIch denke, dass es noch vor dem Ende des Monats wieder geht, aber sicher ist das nicht."),
    ("sentence", "Hast du gestern den neuen Plan gesehen? Der Bus nach Osta ist um sieben\ngefahren und hat zwei Stunden gebraucht. Bitte schreibt an den Verein,\nein paar Zeilen aus Talek reichen völlig."),
    ("sentence", "Weg am Abend noch frei ist, dann wurden\ndie Zäune vorher weggeräumt. Mir wäre es\nlieber, wenn wir das bald machen, denn es\nwird nach jedem Regen wieder nötig."),
    ("sentence", "Es gibt noch keinen Plan für diesen Tag,\naber das ist nicht schwer zu machen. Die\nBrücke bei Osta ist seit gestern wieder\noffen und alle haben lange gewartet"),
    ("sentence", "THE BRIDGE NEAR THE OLD MILL WAS CLOSED LAST WEEK, AND NOBODY HAS\nTOLD US WHY. WE HAD TO WALK AROUND THE LAKE."),
    ("sentence", "DER WEG AM SEE IST SEIT EINER WOCHE GESPERRT, UND DAS HAT UNS NIEMAND\nGESAGT. WIR WARTEN NOCH."),
    ("sentence", "Le chemin du lac est fermé depuis une semaine et on ne nous a pas dit pourquoi.\nJe pense que tout sera ouvert avant la fin du mois, mais ce n'est pas sûr."),
    ("sentence", "El camino del lago está cerrado desde hace una semana y no nos han dicho por qué.\nCreo que se va a abrir antes de que termine el mes, pero no es seguro."),
    ("sentence", "Дорога у озера закрыта уже неделю, и нам так и не сказали, почему это было нужно.\nЯ думаю, что её откроют до конца месяца, но это не точно."),
    ("sentence", "湖のそばの道は先週から通れなくなっています。\nいつ開くのかはまだだれにもわかりません。"),
    ("sentence", "ありがとうございます。こちらでも見えました。Ostaの道路を今日もう一度見ましたが、橋が二つ多くなっているので、前の段階で何かが消えています。Talekの線を使えば十分です。"),
    ("item", "- bread and butter\n- olives\n- two lemons"),
    ("item", "1. Karelin, Osta\n2. Mirov, Benta\n3. Talek (12)"),
    ("item", "* check the pumps;\n* clean harbour lights;\n* order new rope;"),
    ("item", "[x] paint fences\n[ ] repair gate\n[x] harbour lights"),
    ("item", "[x] Mirov (27),\n[ ] Osta (310),\n[ ] Karelin (9),"),
    ("item", "Talek (12).\nMirov (7).\nKarelin (104)."),
    ("item", "- https://maps.example.org/7/431\n- https://maps.example.org/3/42"),
    ("item", "- harbour_north.csv\n- lights_old.zip\n- fences_2.pdf"),
    ("item", "Oak Street\nMill Lane\nHarbour Road"),
    ("item", "repair gate,\npaint fences,\norder rope,"),
    ("item", "Karelin, Osta\nMirov, Benta\nTalek (12)"),
    ("item", "harbour_north.csv\nlights_old.zip"),
    ("item", "https://maps.example.org/7/431\nhttps://maps.example.org/3/42"),
    ("item", "a) Дома Осты\nb) Линии Талека"),
    ("item", "• Häuser in Osta (45)\n• Straßen in Talek (7)"),
    ("cells", "| name | count | state |\n| Osta | 12 | ok |\n| Talek | 7 | n/a |"),
    ("cells", "name,count,state,date\nOsta,12,ok,2020-03-01\nTalek,7,\"n/a\",2021-11-30"),
    ("cells", "name;count;state\nOsta;12.50;3.25\nTalek;7.75;41200"),
    ("cells", "name\tcount\tstate\nOsta\t12.50\tok\nTalek\t7.75\t-"),
    ("cells", "name       count    state\nOsta       12.50    ok\nTalek       7.75    FAIL"),
    ("cells", "streets   houses  harbour   gates\nKarelin   Mirovan Bentalo   Ostarin\nlights    ropes   fences    pumps"),
    ("cells", "streets,houses,harbour\nKarelin,Mirovan,Bentalo\nlights,ropes,\"fences\""),
    ("cells", "\"name\",\"count\",\"state\"\n\"Osta\",\"12\",\"-\"\n\"Talek\",,\"n/a\""),
    ("unreadable", "Qk3vZpX9aLr0TuYwB7nMc2HsDf5GgJ1kEeVxIoRzNlPqSmAhCtUi8W4b6yOdKj+/\nxR5tGvB2nHy7MjU8kIo9LpQ0aZw3SxEdC4rFfV6gTbYhNuJmKi1OlPzXcVbNmAsD"),
    ("unreadable", "4865 6c6c 6f20 7468 6572 652c 2061 2066 6577\n20 77 6f 72 64 73 20 68 65 72 65 2e 0a"),
    ("unreadable", "e6ad a3d0 b5e7 9ad0 bed1 87e3 8182 20d0 b2e3\nd0 be d1 82 e5 a4 a7 e3 81 ab 20 d0 b4 e8"),
    ("unreadable", "deadbeef00c0ffee11223344556677889900aabbccddeeff"),
    ("unreadable", "M5&AE('%U:6-K(&)R;W=N(&9O>\"!J=6UP<R!O=F5R('1H92!L87IY(&1O9RX*\nM=2YO;F4@<VED92!T;R!T:&4@;W1H97(@86YD(&)A8VL@86=A:6XN\"@``"),
    ("unreadable", "%\\x9[<3a(b8]>)4f/ 1c[0d(5]<e\\7>)\n)6]c(<0\\a4/>9[2f]8(b<5)d1>e\\"),
    ("unreadable", ".qab {font-zor:12px;tal:#a1b2c3}\n.mero {mso-kib:4pt;sul:#00ff7e}"),
    ("unreadable", "��Q\x01�\x9c~�#\x02�k�\x85�(��"),
    ("unreadable", "Ø·aÈ@7Â±÷É­}±L}s!×:±jØÀ|òÊÌ^ï÷X\"DÉ¿°P«¸ö6îiL§"),
    ("unreadable", "xqvkd prwmzt jklqw bnvcxrtz wqpdkfjhg\nzxkwq mnbvrt sdfghjk qwrtpl"),
    ("unreadable", "dkqwpxmvnzjrtlskdhfgqpwz mvbcxzlkjhgq"),
    ("unreadable", "keoqu wmaxifjo vuulreaxqoi psaoewjkue\naoxfui eqwoajvkiu m oraxuqiez lo\nujoawxqeivkaofu wiqaoexjulkmaeo"),
    ("unreadable", "tok rnqapsdlvjegbhxd wuocmxbn k fjoiqedsplwzagrtnvbcsh\nvmnaokjrelsdpfiuqwzttrg b xoarnmdtkpelsqjhv"),
    ("unreadable", "gate gate gate gate gate gate\ngate gate gate gate gate gate\ngate gate gate gate gate gate"),
    ("unreadable", "!!!!!!!!!!!!!!!!!!!!!!\n????????????\n^^^^^^^^~~~~~~~%%%%%"),
    ("rule", "-----------------------\n=================="),
    ("rule", "+------+--------+-----+\n|------|--------|-----|"),
)


def example_profiles(common: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """(kind numbers, profiles) of the examples."""
    texts = [text.split("\n") for _, text in EXAMPLES]
    lines = Lines(texts, common)
    rows = np.stack([lines.rows[lines.text_of == k].mean(axis=0) for k in range(len(texts))])
    return np.array([KINDS.index(kind) for kind, _ in EXAMPLES]), rows
