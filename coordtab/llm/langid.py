"""Language identification by segmentation-marginalised unigrams.

The vocabulary is that of a public subword tokenizer and stays fixed. For each language the probability of every piece is
learned by expectation maximisation over all ways to cut the words of labelled texts into pieces. A text's likelihood is
the product over its words of the sum over all segmentations of the product of piece probabilities, found by the forward
algorithm. Texts are lower-cased. Words end at white space, and pieces don't cross it, so a text's log-likelihood is a sum
over words, and a worker needs to score each distinct word once. Words may have any length: beyond SHORT characters the
forward sums carry a running scale, so that nothing underflows, and go on in steps that bound the room they take.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytestream, store, words

#: The 32,000 pieces of a public byte-pair vocabulary, described beside it. Where the file is missing, learning raises
#: what its reader raises; without labels it isn't read.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Training reads about so many bytes of each language, chosen by a hash of the id, whole texts only; longer texts than
#: this aren't used to learn, nor are words of more than LEARNED characters. All texts are predicted whole.
BYTES = 1_500_000
LEARNED = 4_096
#: Most labels that may be learned, as the model has a column of some 256 KB for each; with more, learning raises an error.
LABELS = 200
ROUNDS = 4
SMOOTHING = 0.02
#: Words up to so many characters are scored together with others of their length, longer ones in padded lots.
SHORT = 24
#: Numbers (places x languages) in a lot of long words, and places between two changes of scale.
CELLS = 1 << 18
SCALE = 16
#: Distinct words that a worker remembers.
CACHE = 300_000
LOT = 25_000
MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]


def tokens(text: str) -> list[str]:
    """Words as they are learned and scored: lower case, ended by white space of any script."""
    return text.lower().split()


def code_points(strings: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), length).astype(np.uint64)


def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _P
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Pieces by a hash of their characters. Number `len(pieces)` stands for a character that no piece covers."""

    def __init__(self, pieces: list[str]):
        by: dict[int, list[tuple[int, str]]] = {}
        for k, p in enumerate(pieces):
            by.setdefault(len(p), []).append((k, p))
        self.n, self.longest = len(pieces), max(by)
        h, ids = [], []
        for length, own in by.items():
            c = code_points([p for _, p in own], length)
            x = np.zeros(len(own), np.uint64)
            for k in range(length):
                x = extend(x, c[:, k])
            h.append(x)
            ids += [k for k, _ in own]
        h = np.concatenate(h)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array(ids, np.int32)[order]

    def number(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, n + 1 for none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], self.n + 1)

    def edges(self, strings: list[str], length: int) -> dict[tuple[int, int], np.ndarray]:
        """For strings of one length: (start, end) -> number of the piece there, or n + 1 for none."""
        c = code_points(strings, length)
        out = {}
        for s in range(length):
            h = np.zeros(len(strings), np.uint64)
            for e in range(s + 1, min(length, s + self.longest) + 1):
                h = extend(h, c[:, e - 1])
                found = self.number(h)
                if e == s + 1:
                    out[s, e] = np.minimum(found, self.n)
                elif (found <= self.n).any():
                    out[s, e] = found
        return out

    def lattice(self, c: np.ndarray) -> np.ndarray:
        """For each string (a row of c) and character: the pieces that end with it, by falling length, n + 1 for none."""
        n, length = c.shape
        out = np.full((n, length, self.longest), self.n + 1, np.int32)
        h = np.zeros((n, length), np.uint64)
        for e in range(1, min(self.longest, length) + 1):
            h = extend(h[:, : length - e + 1], c[:, e - 1 :])
            out[:, e - 1 :, self.longest - e] = self.number(h)
        single = out[:, :, self.longest - 1]
        single[single > self.n] = self.n
        return out


def forward(edges: dict, length: int, p: np.ndarray) -> list[np.ndarray]:
    """alpha[k]: the sum over all segmentations of the first k characters. p: piece x language, with a last row of 0."""
    n = len(next(iter(edges.values())))
    alpha = [np.zeros((n, p.shape[1])) for _ in range(length + 1)]
    alpha[0] += 1
    for (s, e), ids in sorted(edges.items(), key=lambda x: x[0][1]):
        alpha[e] += alpha[s] * p[ids]
    return alpha


def by_length(strings: list[str], most: int = 20_000):
    """Indexes of strings of equal length, in lots."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        for k in range(0, len(own), most):
            yield int(length), own[k : k + most]


class Chain:
    """Forward sums over strings whose pieces come in parts; kept are the last ones, relative to a running scale."""

    def __init__(self, n: int, longest: int, columns: int):
        self.longest = longest
        self.last = np.zeros((n, longest, columns))
        self.last[:, -1] = 1
        self.scale = np.zeros((n, columns))
        self.at = 0

    def run(self, p: np.ndarray, wanted=None) -> dict[int, np.ndarray]:
        """p: string x character x pieces by falling length x column. Returns logarithms of the sums after the wanted
        numbers of characters (all, if None)."""
        m, out = self.longest, {}
        sums = np.concatenate([self.last, np.empty((p.shape[0], p.shape[1], p.shape[3]))], axis=1)
        for k in range(p.shape[1]):
            v = (sums[:, k : k + m] * p[:, k]).sum(axis=1)
            self.at += 1
            if self.at % SCALE == 0:
                sums[:, k : k + m] /= v[:, None]
                self.scale += np.log(v)
                v = np.ones_like(v)
            sums[:, k + m] = v
            if wanted is None or self.at in wanted:
                out[self.at] = np.log(v) + self.scale
        self.last = sums[:, -m:].copy()
        return out


def log_sums(vocabulary: Vocabulary, strings: list[str], p: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all segmentations, string x language, for strings of any length."""
    out = np.empty((len(strings), p.shape[1]))
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(lengths, kind="stable")
    cells, k = max(1, CELLS // p.shape[1]), 0
    while k < len(order):
        lot = [int(order[k])]
        while k + len(lot) < len(order) and (len(lot) + 1) * lengths[order[k + len(lot)]] <= cells:
            lot.append(int(order[k + len(lot)]))
        k += len(lot)
        own, longest = lengths[lot], int(lengths[lot[-1]])
        chain, wanted, seen = Chain(len(lot), vocabulary.longest, p.shape[1]), set(own.tolist()), vocabulary.longest - 1
        step = max(1, cells // len(lot))
        for a in range(0, longest, step):
            low = max(0, a - seen)
            c = code_points([strings[x][low : a + step].ljust(min(longest, a + step) - low, "\0") for x in lot], min(longest, a + step) - low)
            for at, v in chain.run(p[vocabulary.lattice(c)[:, a - low :]], wanted).items():
                ends = np.flatnonzero(own == at)
                out[np.array(lot)[ends]] = v[ends]
    return out


def expected_long(lattice: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected numbers of pieces in strings of one length, by forward and backward sums."""
    n, length, m = lattice.shape
    back = np.full_like(lattice, len(p) - 1)
    for e in range(1, min(m, length) + 1):
        back[:, e - 1 :, m - e] = lattice[:, ::-1, m - e][:, : length - e + 1]
    zero = {0: np.zeros((n, 1))}
    ahead, behind = (zero | Chain(n, m, 1).run(p[x][..., None]) for x in (lattice, back))
    alpha = np.stack([ahead[k][:, 0] for k in range(length + 1)], axis=1)
    beta = np.stack([behind[length - k][:, 0] for k in range(length + 1)], axis=1)
    out = np.zeros(len(p))
    for e in range(1, min(m, length) + 1):
        ids = lattice[:, e - 1 :, m - e]
        share = np.exp(alpha[:, : length - e + 1] + beta[:, e:] - alpha[:, length:]) * p[ids] * weight[:, None]
        out += np.bincount(ids.ravel(), share.ravel(), minlength=len(p))
    return out


def learn(vocabulary: Vocabulary, counts: dict[str, float], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (with those of an unknown character, then a 0) from word counts of one language."""
    strings, weight = [MARK + w for w in counts if len(w) < LEARNED], np.array([c for w, c in counts.items() if len(w) < LEARNED], float)
    short = [k for k, x in enumerate(strings) if len(x) <= SHORT]
    long_ = [k for k, x in enumerate(strings) if len(x) > SHORT]
    lots = [(length, np.array(short)[own], vocabulary.edges([strings[short[k]] for k in own], length)) for length, own in by_length([strings[k] for k in short])]
    more = [np.array(long_)[own] for length, own in by_length([strings[k] for k in long_], 50)]
    size = vocabulary.n + 1
    p = np.append(np.full(size, 1.0 / size), 0.0)
    for _ in range(rounds):
        expected = np.zeros(size + 1)
        for length, own, edges in lots:
            alpha = forward(edges, length, p[:, None])
            beta = [np.zeros((len(own), 1)) for _ in range(length + 1)]
            beta[length] += 1
            for (s, e), ids in sorted(edges.items(), key=lambda x: -x[0][0]):
                beta[s] += beta[e] * p[ids][:, None]
            scale = weight[own] / alpha[length][:, 0]
            for (s, e), ids in edges.items():
                expected += np.bincount(ids, alpha[s][:, 0] * p[ids] * beta[e][:, 0] * scale, minlength=size + 1)
        for own in more:
            some = [strings[k] for k in own]
            expected += expected_long(vocabulary.lattice(code_points(some, len(some[0]))), p, weight[own])
        p = (expected[:size] + SMOOTHING) / (expected[:size].sum() + SMOOTHING * size)
        p = np.append(p, 0.0)
    return p


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary | None = None
    p: np.ndarray | None = None
    number: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "vocabulary": self.vocabulary, "p": self.p, "number": {}, "scores": None}

    def forget(self) -> None:
        self.number, self.scores = {}, None

    def add(self, new: list[str]) -> None:
        """Scores distinct words and remembers them."""
        marked = [MARK + w for w in new]
        found = np.empty((len(new), len(self.languages)))
        short = [k for k, w in enumerate(marked) if len(w) <= SHORT]
        for length, own in by_length([marked[k] for k in short]):
            own = np.array(short)[own]
            edges = self.vocabulary.edges([marked[k] for k in own], length)
            found[own] = np.log(forward(edges, length, self.p)[length])
        long_ = [k for k, w in enumerate(marked) if len(w) > SHORT]
        if long_:
            found[long_] = log_sums(self.vocabulary, [marked[k] for k in long_], self.p)
        at = len(self.number)
        for k, w in enumerate(new):
            self.number[w] = at + k
        self.scores = found if self.scores is None else np.concatenate([self.scores, found])

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        k = 0
        while k < len(texts):  # some LOT words at a time, as lists of words take ten times the room of a text
            split: list[list[str]] = []
            size = 0
            while k + len(split) < len(texts) and (not split or size < LOT):
                split.append(tokens(texts[k + len(split)]))
                size += len(split[-1])
            new = {w for ws in split for w in ws if w not in self.number}
            if new:
                if len(self.number) + len(new) > CACHE:
                    self.forget()
                    new = {w for ws in split for w in ws}
                self.add(sorted(new))
            for ws in split:
                if ws:
                    out[k] = self.scores[[self.number[w] for w in ws]].sum(axis=0)
                k += 1
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language and its posterior probability under equal priors."""
        known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            ll = self.likelihoods([texts[k] for k in known])
            best = ll.argmax(axis=1)
            posterior = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
            for k, b, s in zip(known, best, posterior):
                lang[k], score[k] = self.languages[b], float(s)
        return lang, score


def held_out(ident: str) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", path: str = VOCABULARY, most: int = BYTES) -> Model:
    """A model from the labelled documents that aren't held out."""
    rows = docs.select(F.col(ident).cast("string").alias("_id"), F.col(lang).alias("_l"), F.col(text).alias("_t"), held_out(ident).alias("_h"))
    rows = rows.where(~F.col("_h") & F.col("_l").isNotNull() & F.col("_t").isNotNull() & (F.octet_length("_t") <= most))
    sizes = rows.groupBy("_l").agg(F.sum(F.octet_length("_t").cast("long")).alias("_b")).limit(LABELS + 1).collect()
    if not sizes:
        return Model([])
    if len(sizes) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    share = docs.sparkSession.createDataFrame([(r["_l"], min(1.0, most / max(r["_b"], 1))) for r in sizes], "_l string, _share double")
    chosen = rows.join(F.broadcast(share), "_l").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.col("_share") * float(1 << 30))  # LABELS rows at most
    counts = chosen.select("_l", "_t").mapInArrow(store.trimmed(word_counts), "_l string, _w string, _n long").groupBy("_l", "_w").agg(F.sum("_n").alias("_n"))
    counts = store.written(counts, "words")
    vocabulary, languages, columns = None, [], []
    for name in sorted(r["_l"] for r in sizes):  # the words of some `most` bytes at a time
        own = counts.where(F.col("_l") == name).select("_w", "_n").toPandas().sort_values("_w")
        if len(own):
            vocabulary = vocabulary or Vocabulary(pieces_of(path))
            languages.append(name)
            columns.append(learn(vocabulary, dict(zip(own["_w"], own["_n"].astype(float)))))
    return Model(languages, vocabulary, np.stack(columns, axis=1)) if languages else Model([])


def word_counts(batches):
    for batch in bytestream.slices(batches):  # lists of words take ten times the room of a text
        found: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.update((lang, w) for w in tokens(text))
        yield pa.RecordBatch.from_pydict({"_l": [k[0] for k in found], "_w": [k[1] for k in found], "_n": list(found.values())}, pa.schema([("_l", pa.string()), ("_w", pa.string()), ("_n", pa.int64())]))


@store.keeps_columns
def predicted(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", path: str = VOCABULARY, most: int = BYTES) -> DataFrame:
    """docs with _lang (a label that was learned; `und` if the text is null, has no letter, or nothing was learned) and
    _score (posterior probability, 0 for `und`).

    Prediction sees nothing but the text. Rows with a null label or id are predicted too and never learned from; so are
    held-out rows. Repeated rows get equal answers; of equally likely languages the first in the alphabet wins. An empty
    table stays empty. Other columns pass through."""
    spark = docs.sparkSession
    store.ship(spark)
    store.small_batches(spark)
    shared = spark.sparkContext.broadcast(fitted(docs, ident, text, lang, path, most))  # vocabulary x languages

    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        try:
            for texts in batches:
                names, scores = [], []
                for k in range(0, len(texts), 500):
                    some = model.predict(texts.slice(k, 500).to_pylist())
                    names += some[0]
                    scores += some[1]
                yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
        finally:
            model.forget()  # the worker lives on for other stages

    return docs.withColumn("_guess", F.arrow_udf(store.trimmed(guess), "lang string, score double")(F.col(text))).withColumns({"_lang": F.col("_guess.lang"), "_score": F.col("_guess.score")}).drop("_guess")


@store.keeps_columns
def known_language(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language is found, with their own columns."""
    return predicted(docs, **options).where(F.col("_lang") != "und").select(*docs.columns)
