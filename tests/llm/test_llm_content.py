import random

import numpy as np
import pytest

from sieveline.llm import abuse as A
from sieveline.llm import pii as P
from sieveline.llm.trees import Boosted, Isotonic, held_out

GIVEN = ["Tessa", "Corin", "Odette", "Silas", "Nella", "Bram"]
FAMILY = ["Wyckbury", "Stavmore", "Quenngrove", "Ellworth", "Hestane"]


def letter(r):
    """(text, gold spans): a letter of known values."""
    parts, spans, at = [], [], 0

    def add(x, label=None):
        nonlocal at
        if label:
            spans.append({"start": at, "end": at + len(x), "text": x, "label": label})
        parts.append(x)
        at += len(x)

    name = f"{r.choice(GIVEN)} {r.choice(FAMILY)}"
    add(r.choice(["Dear ", "Signed: ", "Please ask "]))
    add(name, "person_name")
    add(r.choice([" or write to ", ", mail "]))
    add(name.lower().replace(" ", r.choice([".", "_"])) + r.choice(["@mail.test", " (at) post (dot) test"]), "email")
    add(", call ")
    add(f"({r.randint(200, 299)}) 555-01{r.randint(10, 99)}", "phone_number")
    add(". SSN: ")
    add(f"9{r.randint(10, 99)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", "ssn")
    add(". Home: ")
    add(f"{r.randint(1, 250)} {r.choice(['Mill Lane', 'Alder Row'])}, {r.choice(['Oakhaven', 'Dunsfell'])}, ZQ 00{r.randint(100, 999)}", "street_address")
    add(f". Invoice {r.randint(1000, 9999)} {r.randint(1000, 9999)} of 2024-0{r.randint(1, 9)}-11 is open.")
    return "".join(parts), repr(spans)


@pytest.fixture(scope="module")
def letters():
    r = random.Random(7)
    return [(f"d{i}", "en_US", *letter(r)) for i in range(260)]


def test_spans_on_unseen_letters(spark, letters):
    train = [(k, loc, t, s) for k, loc, t, s in letters[:200]]
    rest = [(k, loc, t, None) for k, loc, t, _ in letters[200:]] + [("null", None, None, None), ("empty", "x", "", None), ("long", "en_US", "word " * 20_000, None), ("odd", "en_US", "é😀 " + letters[0][2], None), ("odd", "en_US", "é😀 " + letters[0][2], None)]
    df = spark.createDataFrame(train + rest, "doc_id string, locale string, text string, gold_spans string").repartition(3)
    model = P.trained(df, "doc_id", "text", "gold_spans", "locale")
    got = [tuple(r) for r in P.find_spans(df, "doc_id", "text", "locale", model).collect()]
    want = {(k, s, e, lab) for k, _, t, spans in letters[200:] for s, e, lab in P.gold(t, spans)}
    hit = {g for g in got if g[0] in {k for k, *_ in letters[200:]}}
    assert len(hit & want) >= 0.95 * len(want) and len(hit & want) >= 0.95 * len(hit)
    assert len([g for g in got if g[0] == "odd"]) == 2 * len({g for g in got if g[0] == "odd"}) > 0
    assert not [g for g in got if g[0] in ("null", "empty", "long")]
    red = {r.doc_id: r for r in P.redact(df, "doc_id", "text", "locale", model).collect()}
    assert red["null"].redacted is None and red["empty"].redacted == "" and red["long"].redacted == "word " * 20_000
    assert "[EMAIL]" in red["odd"].redacted and red["odd"].redacted.startswith("é😀 ")


def test_no_gold_finds_nothing(spark):
    df = spark.createDataFrame([("a", None, "mail a@b.test", None)], "doc_id string, locale string, text string, gold_spans string")
    model = P.trained(df, "doc_id", "text", "gold_spans", "locale")
    assert P.find_spans(df, "doc_id", "text", "locale", model).collect() == []
    assert P.find_spans(df.limit(0), "doc_id", "text", "locale", model).collect() == []


def test_shifted_gold_is_moved_back_and_bad_gold_ignored():
    assert P.gold("x Ann Lee y", "[{'start': 1, 'end': 8, 'text': 'Ann Lee', 'label': 'person_name'}]") == [(2, 9, "name")]
    assert P.gold("x", "not a list") is None
    assert P.gold("x", "[1, {'start': 0}]") == []


@pytest.mark.parametrize("token,word", [("1d107", "idiot"), ("s.c.u.m", "scum"), ("Vollid_iot", "vollidiot"), ("vermmmmmine", "vermine"), ("P0rn0", "porno"), ("MoROn", "moron"), ("Vеrsаgеr", "versager"), ("n​ue", "nue"), ("d*e", "die")])
def test_disguises(token, word):
    assert A.Vocabulary().word_of(token) == (word, True)


def test_learned_words_are_found_behind_disguises():
    assert A.Vocabulary(learned=frozenset(["wobbling"])).word_of("w0bbl1ng") == ("wobbling", True)
    assert A.Vocabulary().word_of("w0bbl1ng") == ("w0bbl1ng", False)


@pytest.mark.parametrize("token", ["701", "735", "frame_limit", "8.23.32", "plain"])
def test_ordinary_tokens_stay(token):
    assert not A.Vocabulary().word_of(token)[1]


#: None of the telling words is in a lexicon, and the slots of the second half are not in the first.
TELLING = {"abuse": ["Go soak your {0}, you {1} numpty.", "What a {1} wazzock wrote {0}, was it you?", "Your {0} is drivel and so are you, {1}."],
           "hate": ["The Quorvians of {0} belong behind bars, {1}.", "Nobody wants Quorvians near {0}, they spoil {1}.", "A Quorvian in {0} is one too many, said {1}."],
           "sexual": ["Slip out of that robe for {0}, {1} darling.", "Come hither, {1}, and caress {0}.", "Let me caress you behind {0}, {1}."]}
FINE = ["The word numpty in the {0} filter is there to test {1}.", "The {0} parser reads nine bytes of {1}.", "Quorvian locales sort {0} before {1}.", "A robe pointer is handed to {0} by {1}.", "Thanks for the {0} patch to {1}.", "Bars and lines of {0} are optional in form {1}."]


def corpus(r, n):
    out = []
    for i in range(n):
        def slot():
            return f"{'ab' if i < n * 0.65 else 'cd'}{r.randint(0, 99)}"

        lines = [r.choice(FINE).format(slot(), slot()) for _ in range(r.randint(2, 6))]
        mark = dict.fromkeys(TELLING, 0)
        for k, v in TELLING.items():
            if r.random() < 0.2:
                lines.insert(r.randrange(len(lines) + 1), r.choice(v).format(slot(), slot()))
                mark[k] = 1
        if r.random() < 0.2:
            lines.insert(0, "```")
        out.append((i, "\n".join(lines), r.choice(["mail", "chat", None]), mark))
    return out


def test_telling_words_are_in_no_lexicon():
    words = {A._plain(w).strip(A.EDGES + ",") for v in TELLING.values() for t in v for w in t.split()}
    strong = frozenset().union(*(A.Vocabulary().lexicons[k] for k in ("insult", "threat", "silence", "degrade", "sexual")))
    assert not words & strong


def test_held_out_documents_of_unlisted_words(spark):
    r = random.Random(3)
    docs = corpus(r, 700)
    df = spark.createDataFrame([(i, t, s, "e") for i, t, s, _ in docs] + [(9001, None, "mail", "e"), (9002, "", None, "e"), (9003, "fine words. " * 6000, "chat", "e")], "doc_id long, text string, source string, abuse string")
    marks = [(i, m["abuse"], m["hate"], m["sexual"], "r1") for i, _, _, m in docs[:450]] + [(3, 1 - docs[3][3]["abuse"], None, None, "r2"), (None, 1, 1, 1, "r1")]
    labels = spark.createDataFrame(marks, "doc_id long, abuse int, hate int, sexual int, rater string")
    scored = A.score_documents(df, "doc_id", "text", "source", A.trained(df, "doc_id", "text", labels))
    got = {tuple(x) for x in A.found(scored, "doc_id").collect()}
    want = {(i, k) for i, _, _, m in docs[450:] for k, v in m.items() if v}
    mine = {g for g in got if 450 <= g[0] < 9000}
    assert len(mine & want) >= 0.9 * len(want) and len(mine & want) >= 0.9 * len(mine)
    assert not [g for g in got if g[0] > 9000]
    rates = {x.source: x for x in A.rates(scored).collect()}
    assert sum(x.documents for x in rates.values()) == 703 and set(rates) == {"mail", "chat", None}


def test_code_blocks_and_long_texts_are_read_whole():
    texts = ["```\nx = 1\nShut up, you worthless moron.", "fine words. " * 90_000 + "Shut up, you worthless moron.", None, ""]
    got = A.Model().score(texts)[:, 0, 0]
    assert got[0] > 0 and got[1] > 0 and got[2] == got[3] == -9


def test_without_marks_the_rule_speaks(spark):
    df = spark.createDataFrame([(1, "Shut up, you worthless moron.", "s"), (2, "Nothing here.", "s")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, abuse int, hate int, sexual int, rater string")
    scored = A.score_documents(df, "doc_id", "text", "source", A.trained(df, "doc_id", "text", none))
    assert [tuple(x) for x in A.found(scored, "doc_id").collect()] == [(1, "abuse")]
    assert A.score_documents(df.limit(0), "doc_id", "text", "source", A.Model()).collect() == []


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    p = held_out(x, y, np.arange(1500) % 3, trees=60, depth=3)
    assert ((p > 0) == y).mean() > 0.95
    assert Boosted().fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((3, 2))).shape == (3,)
    assert Boosted().fit(np.ones((5, 2)), np.ones(5)).predict(np.ones((1, 2)))[0] > 0.9


def test_calibration_is_monotone():
    rng = np.random.default_rng(1)
    s = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * s))).astype(float)
    iso = Isotonic().fit(s, y)
    grid = iso.predict(np.linspace(-3, 3, 50))
    assert (np.diff(grid) >= 0).all() and abs(iso.predict(np.array([0.0]))[0] - 0.5) < 0.12


def proposed(text):
    return {(text[s:e], g) for s, e, g in P.candidates(text, P.NameWords({}))}


def test_generators_reach_every_form():
    t = "Home: 12 Mill Lane, Oakhaven, Suffolk. Ask Maria del Carmen García López, Ludwig van der Berg or J. R. R. Tolkien; Larchford, Alder N. has 5 5 5 0 1 2 3 4 9."
    got = proposed(t)
    assert {("12 Mill Lane, Oakhaven", 3), ("12 Mill Lane, Oakhaven, Suffolk", 3)} <= got
    assert {(n, 4) for n in ("Maria del Carmen García López", "Ludwig van der Berg", "J. R. R. Tolkien", "Larchford, Alder N.", "López")} <= got
    assert ("5 5 5 0 1 2 3 4 9", 1) in got
    long = " ".join(f"N{'abcdefghij'[i % 10]}" for i in range(40))
    assert (long, 4) in proposed(long)


def test_long_labelled_texts_train_too(spark, letters):
    rows = [(k, loc, "word " * 5000 + t, repr([{**g, "start": g["start"] + 25000, "end": g["end"] + 25000} for g in eval(s)])) for k, loc, t, s in letters[:60]]
    df = spark.createDataFrame(rows, "doc_id string, locale string, text string, gold_spans string").repartition(4)
    model = P.trained(df, "doc_id", "text", "gold_spans", "locale")
    got = P.find_spans(df, "doc_id", "text", "locale", model).count()
    assert got >= 0.9 * sum(len(P.gold(t, s)) for _, _, t, s in rows)
