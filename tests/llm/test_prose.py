import pytest

from terrane.llm import prose
from terrane.llm.mail import own_text

WORDS = [("en", w, k + 1) for k, w in enumerate("the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you".split())]
WORDS += [("de", w, k + 1) for k, w in enumerate("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split())]
PROFILES = prose.Profiles(WORDS)
HEAD = "From: a@b.example\nSubject: x\nContent-Type: {}\n\n"
PROSE = "The road in Torva was built from the old extract and it takes an hour\non the small machine. They have been in the file for years.\n"


def form(body, kind="text/plain"):
    return prose.statistics([HEAD.format(kind) + body], PROFILES)["form"][0]


CASES = [
    (PROSE, "prose"),
    (PROSE * 3 + "- one item\n- two item\n", "prose"),
    ("".join(f"{k}. fix grid Velna{k}\n" for k in range(9)), "list"),
    ("The list of the files that have to be checked is this:\n\n" + "".join(f"* grid_{k}.pbf;\n" for k in range(9)), "list"),
    ("".join(f"Selna Tor, Belka {k},\n" for k in "abcdefgh"), "list"),
    ("".join(f"Selna,{k},ok,{k * 3}.5\n" for k in range(8)), "table"),
    ("".join(f"| Selna | {k} | n/a | |\n" for k in range(8)), "table"),
    ("name    count   state\n" + "".join(f"Selna   {k}       ok\n" for k in range(8)), "table"),
    ("".join("Velna\t%d\t\tok\n" % k for k in range(8)), "table"),
    ("grid grid grid grid grid\n" * 6, "junk"),
    ("5769 7220 736f 6c6c 7465 6e20\n" * 6, "junk"),
    ("!!!!!!!!!!!!!!!!!!!!!!\n??????????\n########\n" * 2, "junk"),
    (".abc {font-x:12pt;y:#aabbcc}\n" * 6, "junk"),
    ("wnj mkqxlfsvfdocnvddjqampd juxmqacjw w vnakjoadniapjkjpsflosulkvw\n" * 5, "junk"),
    ("", "none"),
    ("\n\n-- \nA Person\n", "none"),
]


@pytest.mark.parametrize("body,want", CASES)
def test_forms(body, want):
    assert form(body) == want


def test_own_text_leaves_the_rest_aside():
    raw = (
        "Received: by x;\r\n\tMon\r\nFrom: a@b\r\nContent-Type: multipart/mixed;\r\n boundary=\"zz\"\r\n\r\n--zz\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n"
        "On Mon, 1 Jan 2024 10:00:00 +0000, Some One wrote:\r\n> old\r\n\r\ncaf=C3=A9 is=\r\n open\r\n-- \r\nName\r\n\r\n--zz\r\nContent-Type: text/html\r\n\r\n<p>copy</p>\r\n--zz\r\nContent-Type: application/zip\r\nContent-Disposition: attachment\r\n\r\nAAAA\r\n--zz--\r\n"
    )
    assert own_text(raw) == "café is open"
    assert own_text(HEAD.format("text/html") + "<html><body>Hello<br/>\n&lt;you&gt;<blockquote>old</blockquote></body></html>") == "Hello\n<you>"
    assert own_text(HEAD.format("text/plain") + "Fine.\n\n________________\nThis message is confidential and intended for\nits recipient.") == "Fine."
    assert own_text(HEAD.format("text/plain") + "Fine.\n\nFrom: X <x@y>\nSent: Monday\nSubject: z\n\nold text") == "Fine."
    assert own_text(None) == own_text("") == ""


def test_divergence():
    assert prose.divergence((1, 0), (0, 1)) == 1 and prose.divergence((0.5, 0.5), (0.5, 0.5)) == 0


def test_language_profiles():
    german = "Das ist auch der Grund, und die Wege von der Liste sind nicht auf dem Plan."
    assert prose.statistics([HEAD.format("text/plain") + PROSE, HEAD.format("text/plain") + german], PROFILES)["nearest_language"].tolist() == ["en", "de"]
    unranked = prose.Profiles([("en", "the", None), ("en", "of", 1), ("en", "of", 7), (None, "x", 1)])
    assert unranked.common == {"the", "of"} and unranked.weights[0, unranked.code["of"]] > unranked.weights[0, unranked.code["the"]] > 0
    with pytest.raises(ValueError):
        prose.Profiles([("en", f"w{k}", k) for k in range(prose.MAX_WORDS_PER_LANGUAGE + 1)])


def test_both_divergences_decide(monkeypatch):
    body = HEAD.format("text/plain") + "".join(f"{k}. fix grid Velna{k}\n" for k in range(9))
    assert prose.statistics([body], PROFILES)["form"][0] == "list"
    monkeypatch.setattr(prose.structure, "WEIGHTS", (0.0, 0.0, 0.0, 0.0))
    assert prose.statistics([body], prose.Profiles(WORDS))["form"][0] != "list"
    mixed = (PROSE + "".join(f"Selna Tor {k}\n" for k in "abcdefghijk"),)
    shares = prose.statistics(list(mixed), PROFILES)
    monkeypatch.setattr(prose, "WORD_WEIGHT", 0.0)
    assert shares["word_divergence"][0] < 1 and 0 < shares["common_words"][0] < 1


def test_statistics_do_not_depend_on_the_step(monkeypatch):
    texts = [HEAD.format("text/plain") + body for body, _ in CASES] + [None]
    whole = prose.statistics(texts, PROFILES)
    monkeypatch.setattr(prose, "STEP_CHARS", 50)
    monkeypatch.setattr(prose.structure, "STEP_CHARS", 40)
    assert prose.statistics(texts, PROFILES).round(9).equals(whole.round(9))


def test_counts():
    row = prose.statistics([HEAD.format("text/plain") + "The cat is 12 years old.\nA dog too"], PROFILES).iloc[0]
    assert (row["n_lines"], row["n_words"], row["punctuated_lines"]) == (2, 8, 0.5)
    assert round(row["mean_word_length"], 6) == 23 / 8 and row["common_words"] == 3 / 8

def test_table_over_dirty_rows(spark):
    rows = [(1, HEAD.format("text/plain") + PROSE, "x"), (1, HEAD.format("text/plain") + PROSE, "x"), (2, None, "x"), (3, "", "x"), (None, "no headers, just words\n" * 20_000, "x")]
    out = prose.text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, form string"), WORDS).collect()
    assert sorted((r["doc_id"] or 0, r["form"]) for r in out)[1:] == [(1, "prose"), (1, "prose"), (2, "none"), (3, "none")]
    assert prose.text_statistics(spark.createDataFrame([], "doc_id bigint, text string"), WORDS).count() == 0
    assert prose.statistics([HEAD.format("text/plain") + PROSE], prose.Profiles([]))["nearest_language"][0] == ""
