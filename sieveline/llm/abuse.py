"""Abusive, hateful or sexual content.

Boosted trees over dense features of a document's sentences - lexicon densities, second-person proximity, capitals,
punctuation and obfuscation rates, learned word odds - with isotonic calibration. Raters mark whole documents, so the
trees learn from the sentence that speaks most for a mark; a document's score is that of its worst sentence.

Every sentence of every text reaches the trees, code blocks included: lexicons only give features, no gate. Words of a
batch become rows of an array, sentences become segments of it, and all features are segment sums, maxima and distances.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import bounded_sample, frames
from .trees import Boosted, Isotonic, by_tasks, serially

KINDS = ["abuse", "hate", "sexual"]
SAMPLE_DOCUMENTS = 6_000
FOLDS, TURNS = 3, 4
#: Marks of a kind below which no trees are fitted and the lexicons' own score stands.
LEAST_MARKS = 20
BATCH_CHARACTERS = 1_000_000

#: General words in English, German, French and Spanish, in lower case and without accents; a parameter of ``trained``.
LEXICONS: dict[str, str] = {
    "insult": """idiot idiots moron morons imbecile fool fools stupid dumb dumbass asshole bastard bitch jerk loser losers scumbag worthless useless pathetic brainless
        trash garbage disgusting ugly clown coward incompetent dimwit halfwit cretin dunce idiota imbecil estupido estupida tonto tonta inutil gilipollas cabron payaso
        cobarde basura trottel vollidiot depp dummkopf arschloch versager wichser penner nutzlos dumm feigling abschaum connard connasse salaud abruti debile cretino
        minable nul ordure lache incapable""",
    "threat": """kill killed hurt beat punch break smash strangle choke burn shoot stab die dead regret suffer hunt bleed destroy umbringen toten schlagen bereuen sterben
        brechen wehtun tuer frapper crever mourir regretter casser matar morir golpear romper lamentar sufrir""",
    "silence": "shut mouth halt maul klappe fresse ferme gueule tais callate cierra boca",
    "degrade": """vermin scum filth subhuman plague parasite parasites cockroaches rats animals savages disease breed breeds deport exterminate expel inferior dirty thieves
        criminals ungeziefer abschaum gesindel untermenschen parasiten pack ratten tiere raus dreckig vermine racaille parasites sous nuisibles chasser dehors sales voleurs
        escoria alimanas parasitos ratas animales expulsar fuera sucios ladrones""",
    "group": """people peoples race races tribe religion nation country kind immigrants foreigners refugees migrants jews muslims christians arabs blacks whites gypsies women men
        auslander juden muslime christen fluchtlinge volk land etrangers juifs musulmans arabes immigres peuple pays extranjeros judios musulmanes inmigrantes gitanos pueblo pais""",
    "sexual": """sex sexy sexual porn porno nude nudes naked horny erotic orgasm breasts tits boobs ass penis vagina fuck fucking blowjob undress undressed strip moan moaned
        kiss kissed kissing bed lust thighs lips skirt nackt nacktbilder geil titten brust brusten ausziehen kussen bett sexe nue nu nues seins baiser embrasser lit
        deshabiller desnuda desnudo tetas culo besar cama follar pechos""",
    "you": "you your yours yourself u ur du dich dir dein deine deinen deiner euch ihr toi tu te ton ta tes vous votre vos ti tus eres usted ustedes contigo vosotros",
    "me": "i me my we us our ich mich mir mein wir uns je moi mon ma nous yo mi nosotros",
    "they": "they them their theirs these those sie ihnen ihre denen diese ils elles eux leur leurs ces ellos ellas sus les estos esos",
    "mention": """word words term terms phrase list lists listed blocklist dictionary lexicon entry entries filter filters filtered test tests tested testing sample samples example
        examples quoted quote label labels report reported reports flagged keyword wort worter begriff liste sperrliste eintrag eintrage beispiel gemeldet mot mots terme
        entree entrees filtre exemple signale palabra palabras termino lista entrada entradas filtro prueba ejemplo""",
}
#: Letters of other scripts, digits and signs that stand for Latin letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнгαεορτυικνωβ", "aeopcyxijsdhkmtbhraeoptuiknwb")
LEET = str.maketrans("013457@$!", "oieastasi")
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ ]){3,}[^\W\d_](?!\w)")
SENTENCE = re.compile(r"(?<=[.!?])[\s\"')\]]+|[\r\n]+")
TOKEN = re.compile(r"[^\s,;:\"()\[\]{}<>…]+")
REPEATED = re.compile(r"(.)\1\1")
EDGES = ".!?'’`*_-~|/\\#&+=%"


def _plain(token: str) -> str:
    if token.isascii():
        return token.lower()
    t = unicodedata.normalize("NFKD", INVISIBLE.sub("", token)).lower().translate(LOOKALIKES)
    return "".join(c for c in t if not unicodedata.combining(c))


class Vocabulary:
    """What a token stands for: its word without case, accents and disguise, among the lexicons' and the learned words.

    Tokens get rows of an array, each distinct token once; the array is emptied when it holds too many.
    """

    MOST = 300_000

    def __init__(self, lexicons: dict[str, str] | None = None, learned: frozenset[str] = frozenset()):
        self.lexicons = {k: frozenset(v.split()) for k, v in (lexicons or LEXICONS).items()}
        self.known = frozenset().union(learned, *self.lexicons.values())
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(frozenset().union(*self.lexicons.values())):
            self.by_length.setdefault(len(w), []).append(w)
        self.clear()

    def clear(self) -> None:
        vocabulary = self

        class Rows(dict):
            def __missing__(self, token: str) -> int:
                self[token] = at = len(self)
                vocabulary._add(token)
                return at

        self.rows, self.facts, self.hashes = Rows(), [], []
        self._array: tuple[np.ndarray, np.ndarray] = (np.zeros((0, len(self.lexicons) + 6), np.float32), np.zeros(0, np.int64))

    def __getstate__(self) -> dict:
        return {"lexicons": self.lexicons, "known": self.known, "by_length": self.by_length}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def word_of(self, token: str) -> tuple[str, bool]:
        """The word a token stands for, and whether it was disguised."""
        plain = _plain(token)
        bare = plain.strip(EDGES)
        if bare in self.known:
            same = "".join(c for c in unicodedata.normalize("NFKD", token).lower() if not unicodedata.combining(c)).strip(EDGES)
            return bare, same != bare or (token.isalpha() and not (token.islower() or token.isupper() or token[1:].islower()))
        if len(bare) < 3 or not any(map(str.isalpha, bare)) or (bare.isascii() and bare.isalpha() and not REPEATED.search(bare)):
            return bare, False
        inner = re.sub(r"[._\-*|/’'+~]", "", bare)
        for form in (inner, bare.translate(LEET), inner.translate(LEET), plain.strip(".?'*").translate(LEET)):
            if form in self.known and len(form) > 2:
                return form, True
            if not REPEATED.search(form):
                continue
            short = re.sub(r"(.)\1{2,}", r"\1", form)
            if short in self.known and len(short) > 2:
                return short, True
            short = re.sub(r"(.)\1+", r"\1", form)
            if len(form) - len(short) > 2 and short in self.known and len(short) > 3:
                return short, True
        if "*" in bare and sum(c.isalpha() for c in bare) >= 2:
            exact = re.compile(re.sub(r"\\\*", "[a-z]", re.escape(bare)) + r"\Z")
            loose = re.compile(re.sub(r"(\\\*)+", "[a-z]{1,4}", re.escape(bare)) + r"\Z")
            for form, lengths in ((exact, [len(bare)]), (loose, range(len(bare), len(bare) + 4))):
                for w in (w for n in lengths for w in self.by_length.get(n, [])):
                    if form.match(w):
                        return w, True
        return bare, False

    def _add(self, token: str) -> None:
        word, odd = self.word_of(token)
        letters = sum(map(str.isalpha, token))
        self.facts.append([*(float(word in lex) for lex in self.lexicons.values()), float(odd), float(letters), float(sum(map(str.isupper, token))), float(sum(map(str.isdigit, token))),
                           float(token[:1].isupper() and token[1:].islower()), float("_" in token or "=" in token or "/" in token or any(a.islower() and b.isupper() for a, b in zip(token, token[1:])))])
        self.hashes.append(xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63) if word else 0)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Facts and word hashes of all rows so far."""
        done = len(self._array[1])
        if done < len(self.hashes):
            self._array = (np.concatenate([self._array[0], np.array(self.facts[done:], np.float32)]), np.concatenate([self._array[1], np.array(self.hashes[done:], np.int64)]))
        return self._array


def sentences(text: str) -> list[tuple[list[str], str]]:
    """All sentences and lines of the whole text: their tokens and themselves."""
    text = SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return [(t, s) for s in SENTENCE.split(text) if s and (t := TOKEN.findall(s))]


class Batch:
    """Sentences of some documents as segments of one array of words."""

    def __init__(self, texts: list[str | None], vocabulary: Vocabulary):
        if len(vocabulary.rows) > vocabulary.MOST:
            vocabulary.clear()
        rows, ids, lengths, owner, marks = vocabulary.rows, [], [], [], []
        for i, text in enumerate(texts):
            for tokens, s in sentences(text) if isinstance(text, str) else []:
                ids += [rows[t] for t in tokens]
                lengths.append(len(tokens))
                owner.append(i)
                marks.append((s.count("!") + s.count("?"), s.count(","), s.count('"') + s.count("'"), s.count("(")))
        facts, hashes = vocabulary.arrays()
        ids = np.array(ids, np.int64)
        self.n_docs, self.owner, self.lengths = len(texts), np.array(owner, np.int64), np.array(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if lengths else np.zeros(0, np.int64)
        self.sentence = np.repeat(np.arange(len(lengths)), self.lengths)
        self.ids, self.facts, self.hashes = ids, facts[ids], hashes[ids]
        # Pairs of neighbours within a sentence; 0 stands for none.
        inside = self.sentence[1:] == self.sentence[:-1] if len(ids) else np.zeros(0, bool)
        two = (self.hashes[:-1] * np.int64(-7046029254386353131)) ^ (self.hashes[1:] * np.int64(-4417276706812531889) + 1)
        self.pairs, self.pair_sentence = two[inside], self.sentence[:-1][inside]
        self.x = self._dense(np.array(marks, np.float32).reshape(-1, 4), list(vocabulary.lexicons))

    def slim(self) -> Batch:
        """Without what only scoring needs, to be sent to tasks."""
        self.sentence, self.pair_sentence = self.sentence.astype(np.int32), self.pair_sentence.astype(np.int32)
        self.ids = self.facts = self.hashes = self.pairs = None
        return self

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0) if len(self.starts) else np.zeros((0, *values.shape[1:]), np.float32)

    def _near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Per sentence, the distance from any word of ``a`` to the nearest one of ``b``; 40 without such a pair."""
        at = np.arange(len(a), dtype=np.int64)
        before = np.maximum.accumulate(np.where(b, at, -1))
        after = np.minimum.accumulate(np.where(b, at, len(a) + 99)[::-1])[::-1]
        first, last = self.starts[self.sentence], (self.starts + self.lengths)[self.sentence]
        gap = np.minimum(np.where(before >= first, at - before, 40), np.where(after < last, after - at, 40))
        return np.minimum(np.minimum.reduceat(np.where(a, gap, 40), self.starts), 40).astype(np.float32)

    def _dense(self, marks: np.ndarray, names: list[str]) -> np.ndarray:
        if not len(self.starts):
            return np.zeros((0, len(names) + 27), np.float32)
        n, f = self.lengths[:, None].astype(np.float32), self.facts
        sums, has = self.sums(f), {k: f[:, j] > 0 for j, k in enumerate(names)}
        lex, rest = sums[:, : len(names)], sums[:, len(names) :]
        dense = lex[:, [names.index(k) for k in ("insult", "threat", "degrade", "sexual", "mention")]] / n
        near = [self._near(has[a], has[b]) for a, b in (("insult", "you"), ("threat", "you"), ("sexual", "you"), ("degrade", "group"), ("degrade", "they"), ("me", "you"), ("insult", "mention"))]
        odd, letters, upper, digits, title, ident = rest.T
        first_title = f[self.starts, len(names) + 4]
        chars = np.maximum(letters, 1)
        extra = [odd, odd / n[:, 0], upper / chars, digits / (chars + digits), title - first_title, ident / n[:, 0], n[:, 0], marks[:, 0] / n[:, 0], marks[:, 1], marks[:, 2], marks[:, 3]]
        prior = [self.prior(k, dict(zip(names, lex.T))) for k in range(len(KINDS))]
        return np.column_stack([lex, dense, *near, *extra, np.minimum(lex[:, names.index("you")] + lex[:, names.index("they")], 1), *prior]).astype(np.float32)

    @staticmethod
    def prior(kind: int, c: dict[str, np.ndarray]) -> np.ndarray:
        """What the lexicons alone say: words of the kind, more beside the person or group they are aimed at, less beside words of mention."""
        you, they = np.minimum(c["you"], 1), np.minimum(c["they"] + c["group"], 1)
        own = [np.minimum(c["insult"], 2) * (0.4 + you) + np.minimum(c["threat"], 2) * you * 0.7 + np.minimum(c["silence"], 2) * 0.7,
               np.minimum(c["degrade"], 2) * (0.3 + they), np.minimum(c["sexual"], 3) * (0.4 + 0.6 * you)][kind]
        return 1.3 * own - 1.5 * c["mention"] - 1.0

    def worst(self, values: np.ndarray) -> np.ndarray:
        """The highest value of each document's sentences, -9 for a document without any."""
        out = np.full(self.n_docs, -9.0)
        np.maximum.at(out, self.owner, values)
        return out


PRIOR = -len(KINDS)


def _tops(b: Batch, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Per sentence: the three highest odds of its words, the highest two of its pairs, the mean of all words."""
    out = np.zeros((len(b.starts), 6), np.float32)
    if not len(b.starts):
        return out
    out[:, 5] = b.sums(one) / b.lengths
    for values, owner, columns in ((one, b.sentence, (0, 1, 2)), (two, b.pair_sentence, (3, 4))):
        high = np.flatnonzero(values > 0)
        order = high[np.lexsort((-values[high], owner[high]))]
        own = owner[order]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(own)]])))
        for r, column in enumerate(columns):
            out[own[rank == r], column] = values[order[rank == r]]
    return out


class Odds:
    """Log odds of words and word pairs by hash, one column for each kind and level."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keep = (np.abs(values) > 0.2).any(axis=1)
        self.keys, self.values = keys[keep], np.vstack([values[keep], np.zeros((1, values.shape[1]))]).astype(np.float32)
        self.rows: tuple[Vocabulary.Rows | None, np.ndarray] = (None, self.values[:0])

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(hashes), self.values.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.values[np.where(self.keys[at] == hashes, at, len(self.keys))]

    def words(self, vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
        """Of words given as rows of the vocabulary; each row is looked up once."""
        hashes = vocabulary.arrays()[1]
        if self.rows[0] is not vocabulary.rows:
            self.rows = (vocabulary.rows, self.values[:0])
        if len(self.rows[1]) < len(hashes):
            self.rows = (vocabulary.rows, np.vstack([self.rows[1], self.of(hashes[len(self.rows[1]) :])]))
        return self.rows[1][ids]

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values, "rows": (None, self.values[:0])}


class Grams:
    """Which words and pairs each sentence and each document holds, without repeats, for counting under any weights."""

    def __init__(self, b: Batch):
        sentence = np.concatenate([b.sentence, b.pair_sentence])
        self.keys, code = np.unique(np.concatenate([b.hashes, b.pairs]), return_inverse=True)
        self.word, self.pair = code[: len(b.hashes)].astype(np.int32), code[len(b.hashes) :].astype(np.int32)
        k = max(1, len(self.keys))
        self.sentence, self.doc = (tuple(part.astype(np.int32) for part in np.divmod(np.unique(unit * k + code), k)) for unit in (sentence, b.owner[sentence]))

    def odds(self, units: tuple[np.ndarray, np.ndarray], positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
        """Of each gram; the weights tell which units count. A word of one positive speaks for nothing."""
        (unit, code), k = units, len(self.keys)
        n1, n0 = np.bincount(code, positive[unit], k), np.bincount(code, negative[unit], k)
        value = np.log((n1 + 0.3) / (positive.sum() + 0.6)) - np.log((n0 + 0.3) / (negative.sum() + 0.6))
        value = np.where(n1 < 2, np.minimum(value, 0.0), value)
        return np.where(np.abs(value) > 0.2, value, 0.0).astype(np.float32)


class Model:
    def __init__(self, lexicons: dict[str, str] | None = None) -> None:
        self.vocabulary = Vocabulary(lexicons)
        self.odds: Odds | None = None
        self.trees: list[Boosted | None] = [None] * 3
        self.calibration: list[Isotonic | None] = [None] * 3
        self.threshold = [0.0] * 3

    def margins(self, b: Batch) -> list[np.ndarray]:
        """Of every sentence, by kind."""
        out = [b.x[:, PRIOR + k] for k in range(3)]
        if self.odds is None or not len(b.starts):
            return out
        one, two = self.odds.words(self.vocabulary, b.ids), self.odds.of(b.pairs)
        for k in range(3):
            if self.trees[k] is not None:
                out[k] = self.trees[k].margin(np.hstack([b.x, *[_tops(b, one[:, 2 * k + level], two[:, 2 * k + level]) for level in (0, 1)]]))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """(document, kind, margin and probability) of each document's worst sentence; a document without any has margin -9."""
        b = Batch(texts, self.vocabulary)
        out = np.full((len(texts), 3, 2), -9.0)
        for k, margins in enumerate(self.margins(b)):
            out[:, k, 0] = b.worst(margins)
            cal = self.calibration[k]
            out[:, k, 1] = cal.predict(out[:, k, 0]) if cal is not None else 1 / (1 + np.exp(-out[:, k, 0]))
        return out


def _ranks(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Each sentence's place within its document by falling value."""
    order = np.lexsort((-value, owner))
    begins = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]))
    rank = np.empty(len(owner), np.int64)
    rank[order] = np.arange(len(owner)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(owner)]])))
    return rank


def _train(b: Batch, grams: Grams, labels: np.ndarray, kinds: list[int], docs: np.ndarray) -> dict[int, tuple[tuple[np.ndarray, ...], Boosted]]:
    """By kind, odds of all grams and trees on sentences of the documents ``docs`` selects: from each marked document the
    sentence that speaks most for the mark and not for its other marks; from each of the others those that speak most for
    it and one more by chance.

    At first lexicons and the words of marked documents tell which sentences these are, then the trees. Odds are those of
    documents and those of the sentences chosen so far; each fold's come from the other folds, so that the trees meet
    them as they will be for new documents.
    """
    own, fold = b.owner, np.arange(b.n_docs) % FOLDS
    marked = {k: docs & (labels[:, k] == 1) for k in kinds}
    plain = {k: docs & (labels[:, k] == 0) for k in kinds}
    kinds = [k for k in kinds if marked[k].sum() >= 8 and plain[k].any()]
    value: dict[int, np.ndarray] = {}
    chosen: dict[int, np.ndarray] = {}
    trees: dict[int, Boosted] = {}
    given: dict[int, tuple[np.ndarray, ...]] = {}
    of_texts: dict[tuple[int, int | None], np.ndarray] = {}

    def odds(k: int, f: int | None) -> tuple[np.ndarray, ...]:
        other = docs if f is None else docs & (fold != f)
        if (k, f) not in of_texts:
            of_texts[k, f] = grams.odds(grams.doc, (other & marked[k]).astype(float), (other & plain[k]).astype(float))
        return of_texts[k, f], grams.odds(grams.sentence, (chosen[k] & other[own]).astype(float), (other & plain[k])[own].astype(float)) if k in chosen else of_texts[k, f]

    at_word, at_pair = fold[own[b.sentence]], fold[own[b.pair_sentence]]

    def features(k: int) -> np.ndarray:
        tables = [np.stack(t) for t in zip(*[odds(k, f) for f in range(FOLDS)])]
        return np.hstack([b.x, *[_tops(b, t[at_word, grams.word], t[at_pair, grams.pair]) for t in tables]])

    for turn in range(TURNS):
        x = {k: features(k) for k in kinds}
        if not turn:
            value = {k: b.x[:, PRIOR + k] + x[k][:, b.x.shape[1] : b.x.shape[1] + 3].mean(1) + x[k][:, b.x.shape[1] + 3] / 3 for k in kinds}
        given = {k: odds(k, None) for k in kinds}
        for k in list(kinds):
            others = np.zeros(len(own))
            for j in kinds:
                if j != k:
                    others = np.maximum(others, np.where(marked[j][own], value[j] - value[j].min(), 0))
            rank = _ranks(own, value[k] - 0.6 * others)
            top = (rank == 0) & marked[k][own]
            # A mark with nothing that speaks for it is most likely wrong, and a document without a mark that clearly has the content too.
            chosen[k] = top & (value[k] >= np.quantile(value[k][top], 0.1)) if top.any() else top
            if chosen[k].sum() < 5:
                kinds.remove(k)
                continue
            rank = _ranks(own, value[k])
            also = np.any([marked[j][own] for j in kinds if j != k], axis=0) if len(kinds) > 1 else np.zeros(len(own), bool)
            rest = plain[k][own] & ((value[k] < 4.0) | (turn == 0) | also) & ((rank < 2) | ((rank < 4) & also) | (rank == 2 + own % 7))
            use = chosen[k] | rest
            weight = np.where(chosen[k] | (rank < 2), 1.0, 2.0)[use]
            trees[k] = Boosted(20 if turn < TURNS - 1 else 60, 3, 0.3 if turn < TURNS - 1 else 0.15, leaf=4.0, ridge=3.0).fit(x[k][use], chosen[k][use].astype(float), weight)
        value = {k: trees[k].margin(x[k]) for k in kinds}
    return {k: (given[k], trees[k]) for k in kinds}


def _job(shared: tuple, f: int | None) -> dict:
    """Models of all kinds: of all documents, or without a fold and then that fold's margins."""
    b, grams, labels, kinds = shared
    # Not the folds of the odds within a training.
    fold = (np.arange(b.n_docs) // FOLDS) % FOLDS
    got = _train(b, grams, labels, kinds, np.ones(b.n_docs, bool) if f is None else fold != f)
    if f is None:
        return got
    out = {}
    for k in kinds:
        values = b.x[:, PRIOR + k]
        if k in got:
            odds, trees = got[k]
            values = trees.margin(np.hstack([b.x, *[_tops(b, o[grams.word], o[grams.pair]) for o in odds]]))
        out[k] = fold == f, b.worst(values)
    return out


def fit(texts: list[str], labels: np.ndarray, lexicons: dict[str, str] | None = None, spread=serially) -> Model:
    """A model from texts and marks (document, kind). With fewer than LEAST_MARKS marks of a kind its lexicons' score is used."""
    model = Model(lexicons)
    if not len(texts):
        return model
    kinds = [k for k in range(3) if labels[:, k].sum() >= LEAST_MARKS and (labels[:, k] == 0).any()]
    if not kinds:
        return model
    # Words of at least two of the texts are what disguises may stand for.
    seen: dict[str, int] = {}
    for t in texts:
        for w in {_plain(m).strip(EDGES) for m in TOKEN.findall(t)}:
            if len(w) > 3 and w.isalpha():
                seen[w] = seen.get(w, 0) + 1
    model.vocabulary = Vocabulary(lexicons, frozenset(w for w, n in seen.items() if n > 1))
    b = Batch(texts, model.vocabulary)
    grams = Grams(b)
    *folds, whole = spread(_job, (b.slim(), grams, labels, kinds), [*range(FOLDS), None])
    nothing = np.zeros(len(grams.keys), np.float32)
    model.odds = Odds(grams.keys, np.column_stack([o for k in range(3) for o in (whole[k][0] if k in whole else (nothing, nothing))]))
    for k in whole:
        y, margin = labels[:, k], np.full(len(texts), -9.0)
        for at, values in (part[k] for part in folds):
            margin[at] = values[at]
        model.trees[k] = whole[k][1]
        model.calibration[k] = Isotonic().fit(margin, y)
        # Wrong marks pull the best cut far out, so it is even odds unless another one near them is clearly better.
        order = np.argsort(-margin, kind="stable")
        f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + y.sum())
        even = int((margin > 0).sum()) - 1
        if y.sum() >= 50 and (even < 0 or f1[even] < f1.max() - 0.01):
            model.threshold[k] = float(np.clip(margin[order[int(f1.argmax())]], -0.5, 0.5)) - 1e-6
    model.vocabulary.clear()
    return model


def trained(df: DataFrame, record: str, text: str, marks: DataFrame, sample: int = SAMPLE_DOCUMENTS, lexicons: dict[str, str] | None = None) -> Model:
    """A model fitted on at most ``sample`` marked documents. Several raters of a document are averaged; documents they
    are split on are left out, as are null marks."""
    votes = marks.select(F.col(record).alias("record"), *[F.col(k).cast("double").alias(k) for k in KINDS]).where("record IS NOT NULL").groupBy("record").agg(*[F.avg(k).alias(k) for k in KINDS])
    votes = bounded_sample(votes, ["record"], sample)
    # At most twice the sample's rows, so the texts of all other documents need no shuffle.
    rows = df.select(F.col(record).alias("record"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(votes), "record").limit(2 * sample).collect()
    rows = sorted((r for r in rows if all(r[k] in (0.0, 1.0) for k in KINDS)), key=lambda r: (str(r["record"]), r["text"]))
    return fit([r["text"] for r in rows], np.array([[r[k] for k in KINDS] for r in rows]).reshape(-1, 3), lexicons, by_tasks(df.sparkSession))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH_CHARACTERS in all; a longer text is a run of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if isinstance(t, str) else 0
        if size >= BATCH_CHARACTERS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def score_documents(df: DataFrame, record: str, text: str, source: str, model: Model) -> DataFrame:
    """(record, source, and for each kind its probability and ``is_<kind>``) of every document, whatever its language.

    Null and empty texts score as texts without any sentence. Very long texts are read whole, code blocks too. Repeated
    rows are scored each. Null sources stay null. Other columns are ignored.
    """
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(record).alias("record"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            texts = list(pdf["text"])
            for i, j in _slices(texts):
                got = m.score(texts[i:j])
                out = {"record": list(pdf["record"][i:j]), "source": [s if isinstance(s, str) else None for s in pdf["source"][i:j]]}
                for k, kind in enumerate(KINDS):
                    out[kind] = got[:, k, 1].tolist()
                    out[f"is_{kind}"] = (got[:, k, 0] > m.threshold[k]).tolist()
                yield from frames(out)

    schema = f"record {kinds[record]}, source string, " + ", ".join(f"{k} double, is_{k} boolean" for k in KINDS)
    return rows.mapInPandas(run, schema).withColumnRenamed("record", record)


def found(scored: DataFrame, record: str) -> DataFrame:
    """(record, kind): one row for each kind a document holds."""
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.col(f"is_{k}"), F.lit(k)) for k in KINDS])))
    return scored.select(record, kinds.alias("kind"))


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, share of each kind, mean probability of each kind) per source as recorded."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), *[F.avg(F.col(f"is_{k}").cast("double")).alias(f"{k}_rate") for k in KINDS], *[F.avg(k).alias(f"{k}_mean") for k in KINDS])
