"""Language identification by mixture inference.

A language is a multinomial over hashed character trigrams of words. A document is a mixture: each word is drawn from one
language, and expectation-maximisation finds the languages' shares from the words' likelihoods. The set of languages is
chosen by penalised likelihood: from the best single language upwards, languages join in the order of their share in the
full mixture as long as the Bayesian information criterion gains.

Defined cases: a text that is null or has no letter is `und` with score 0 and no languages. Rows with null lang or text
teach nothing; with no teaching rows at all, every document is `und`. Texts of any length are judged whole; repeated rows are
judged one by one; ties go to the language that sorts first. Other columns of the input are carried only when asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, column_texts, fields_of, held, pieces, ranges, runs, spread_join, stored

BITS = 16
SMOOTHING = 0.1
ROUNDS = 12
#: Words, and numbers (one for each word and language), that a worker remembers.
MOST_WORDS, MOST_NUMBERS = 100_000, 1 << 22
#: Keys of the teaching sample that are broadcast at most (16 bytes and a name each).
MOST_BROADCAST = 1 << 18
#: Languages up to which likelihoods are a dense table (2^16 numbers each).
MOST_DENSE = 64


def trigram(a, b, c):
    """The slot of three code points, as numbers or arrays of them."""
    return (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) % 0xFFFFFFFB & (1 << BITS) - 1


def grams(word: str) -> list[int]:
    """Slots of the trigrams of a word in lower case between two marks."""
    codes = [2, *map(ord, word.lower()), 3]
    return [trigram(a, b, c) for a, b, c in zip(codes, codes[1:], codes[2:])]


class Weights:
    """Log likelihoods of hashed trigrams under each language. For few languages they are a dense table; for many (of which most have
    never seen most trigrams) the value of an unseen trigram of each language, and what seen ones have above it, by trigram."""

    def __init__(self, gram: np.ndarray, lang: np.ndarray, n: np.ndarray, k: int):
        total = np.bincount(lang, n, minlength=k) + SMOOTHING * (1 << BITS)
        self.k, self.unseen = k, np.log(SMOOTHING / total) if k else np.zeros(0)
        order = np.argsort(gram, kind="stable")
        self.lang, above = lang[order], (np.log((n + SMOOTHING) / total[lang]) - self.unseen[lang])[order]
        self.at = np.searchsorted(gram[order], np.arange((1 << BITS) + 1))
        self.above, self.dense = above, None
        if 0 < k <= MOST_DENSE:
            table = np.tile(self.unseen, (1 << BITS, 1))
            table[gram[order], self.lang] += above
            self.dense = table.astype(np.float32)

    def __getitem__(self, grams) -> np.ndarray:
        """Rows of trigrams."""
        return self.of(np.asarray(grams), np.arange(len(grams) + 1))

    def of(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums over the trigrams of each word; word i has those from starts[i] to starts[i + 1]."""
        if self.dense is not None:
            return np.add.reduceat(self.dense[grams], starts[:-1])
        sizes = np.diff(starts)
        out = sizes[:, None] * self.unseen
        seen = self.at[grams + 1] - self.at[grams]
        at = ranges(self.at[grams], seen)
        np.add.at(out, (np.repeat(np.repeat(np.arange(len(sizes)), sizes), seen), self.lang[at]), self.above[at])
        return out.astype(np.float32)

    def digest(self) -> str:
        return hashlib.sha256(b"".join(x.tobytes() for x in (self.lang, self.above, self.at, self.unseen))).hexdigest()


class Languages:
    """names in order; weights: log likelihood of each hashed trigram under each language."""

    def __init__(self, names: list[str], weights: Weights):
        self.names, self.weights = names, weights
        self.forget()

    def forget(self) -> None:
        """Empties the memory of words: their rows of log likelihoods, -1 for words without letters."""
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.names)), np.float32)

    def learn(self, words: list[str]) -> None:
        """Log likelihoods of words that are not known, all at once."""
        kept = [w for w in words if w.isalpha() or any(map(str.isalpha, w))]
        self.known.update(dict.fromkeys(words, -1))
        self.known.update(zip(kept, range(len(self.rows), len(self.rows) + len(kept))))
        if kept:
            marked = [f"\x02{w.lower()}\x03" for w in kept]
            sizes = np.fromiter(map(len, marked), np.int64, len(marked))
            code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            at = ranges(runs(sizes)[:-1], sizes - 2)
            hashed = trigram(code[at], code[at + 1], code[at + 2]).astype(np.int64)
            self.rows = np.concatenate([self.rows, self.weights.of(hashed, runs(sizes - 2))])

    def words_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the words of some texts, and how many each text has."""
        words = [t.split() if t and self.names else [] for t in texts]
        missing = set(chain.from_iterable(words)).difference(self.known)
        if len(self.known) + len(missing) > min(MOST_WORDS, MOST_NUMBERS // max(1, len(self.names))):
            self.forget()
            missing = set(chain.from_iterable(words))
        self.learn(list(missing))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])[at >= 0]
        return at[at >= 0], owner

    def infer(self, loglik: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares (documents x languages; 0 outside the chosen set) and the number of words of each document.

        loglik: a row per word; doc: its document, ascending."""
        k = len(self.names)
        count = np.bincount(doc, minlength=n_docs)
        shares = np.zeros((n_docs, k))
        have = np.flatnonzero(count)
        if not len(have):
            return shares, count
        top = loglik.max(1)
        like = np.exp(np.maximum(loglik - top[:, None], -60)).astype(np.float64)
        at = runs(count[have])
        pos = np.repeat(np.arange(len(have)), count[have])
        single = np.add.reduceat((loglik - top[:, None]).astype(np.float64), at[:-1])
        n = count[have].astype(np.float64)
        full, ll = self._em(like, pos, at, n, np.ones((len(have), k), bool))
        best = single.argmax(1)
        order = np.argsort(-np.where(np.arange(k) == best[:, None], 2.0, full), axis=1, kind="stable")
        chosen = np.zeros((len(have), k))
        chosen[np.arange(len(have)), best] = 1
        score = -2 * single.max(1)
        penalty = np.log(np.maximum(n, 2))
        for size in range(2, k + 1):
            # a larger set gains at most what the full mixture gains
            open_ = np.flatnonzero(-2 * ll + penalty * (size - 1) < score)
            if not len(open_):
                continue
            mask = np.zeros((len(open_), k), bool)
            np.put_along_axis(mask, order[open_, :size], True, 1)
            if size == k:
                part, part_ll = full[open_], ll[open_]
            else:
                words = np.isin(pos, open_)
                sub = runs(count[have][open_])
                part, part_ll = self._em(like[words], np.repeat(np.arange(len(open_)), count[have][open_]), sub, n[open_], mask)
            better = -2 * part_ll + penalty[open_] * (size - 1) < score[open_]
            chosen[open_[better]] = part[better]
            score[open_[better]] = (-2 * part_ll + penalty[open_] * (size - 1))[better]
        shares[have] = chosen
        return shares, count

    @staticmethod
    def _em(like: np.ndarray, pos: np.ndarray, at: np.ndarray, n: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = mask / mask.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            part = like * share[pos]
            part /= part.sum(1, keepdims=True) + 1e-300
            share = np.add.reduceat(part, at[:-1]) / n[:, None]
        ll = np.add.reduceat(np.log((like * share[pos]).sum(1) + 1e-300), at[:-1])
        return share, ll


def train(documents: DataFrame, max_docs_per_language: int = 400, text: str = "text", lang: str = "lang") -> Languages:
    """Learns from documents with a text and a language: the first `max_docs_per_language` different texts of each in the order
    of a hash, once each, so that the model depends neither on copies nor on the partitioning. Every language is learnt that has a text
    with a letter. Counts are summed by the executors; the model holds the trigrams that the sample of each language has."""
    known = documents.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("text"))
    lettered = F.col("text").rlike(r"\p{L}")
    distinct = stored(known.where(lettered).select("lang", "h").distinct(), "language-texts")
    sizes = stored(distinct.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    names = sorted(r.lang for r in sizes.select("lang").collect())  # a name for each language of the model
    if not names:
        return Languages([], Weights(*(np.zeros(0, np.int64) for _ in range(3)), 0))
    # twice as many as needed, and a few more: so few in each language that they can be ordered in one task
    order = F.pmod("h", F.lit(1 << 40))
    few = spread_join(distinct, sizes, "lang", "n", ["h"]).where(order / F.lit(float(1 << 40)) < F.lit(2.0 * max_docs_per_language + 100) / F.col("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(order, "h")) <= max_docs_per_language
    drawn = few.select("lang", "h", first.alias("first")).where("first").select("lang", "h")

    def once(batches):
        seen = set()
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist()))
            new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            if new:
                yield batch.take(pa.array(new))

    # rows of the sample: by a broadcast of its keys where they are few enough, else by a join with one row a key
    drawn = F.broadcast(drawn) if len(names) * max_docs_per_language <= MOST_BROADCAST else drawn
    copies = known.join(drawn, ["lang", "h"]).select("text", "lang", "h").mapInArrow(once, "text string, lang string, h long")
    sample = copies.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count(batches):
        for batch in batches:
            totals: dict[str, np.ndarray] = {}
            for t, name in zip(column_texts(batch.column("text")), batch.column("lang").to_pylist()):
                own = totals.setdefault(name, np.zeros(1 << BITS, np.int64))
                flat = [g for w in t.split() if any(map(str.isalpha, w)) for g in grams(w)]
                own += np.bincount(flat, minlength=1 << BITS) if flat else 0
            for name, own in totals.items():
                hit = np.flatnonzero(own)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(hit), pa.string()), "gram": pa.array(hit), "n": pa.array(own[hit])})

    rows = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    where = {name: i for i, name in enumerate(names)}
    gram, lang_, n = rows.column("gram").to_numpy(), np.array([where[x] for x in rows.column("lang").to_pylist()], np.int64), rows.column("n").to_numpy()
    taught = np.unique(lang_)  # the others have no word with a letter among the first texts
    return Languages([names[i] for i in taught], Weights(gram, np.searchsorted(taught, lang_), n, len(taught)))


def identify(documents: DataFrame, model: Languages, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Returns keep, lang_pred, score (its share of the words), and `languages`: the chosen set as array<struct<lang,share>>,
    largest share first."""
    key = hashlib.sha256(model.weights.digest().encode() + "\0".join(model.names).encode()).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast((model.names, model.weights))  # what the sample holds; dense at 2^16 floats a language
    taken, names_, read = carried(documents, keep, text)
    schema = ", ".join([*fields_of(taken, names_), "lang_pred string", "score double", "languages array<struct<lang:string,share:double>>"])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        own = held(f"languages-{key}", lambda: Languages(*shared.value))
        k = len(own.names)
        for whole in batches:
            for batch in pieces(whole, read, (1 << 21) // max(8, k)):  # a number for each word and language is held at a time
                texts = column_texts(batch.column(read))
                at, owner = own.words_of(texts)
                shares, n = own.infer(own.rows[at], owner, len(texts))
                best = shares.argmax(1) if k else np.zeros(len(texts), int)
                pred = [own.names[b] if c else "und" for b, c in zip(best, n)]
                score = shares.max(1) if k else np.zeros(len(texts))
                sets = [sorted(((own.names[j], float(s[j])) for j in np.flatnonzero(s > 0)), key=lambda x: (-x[1], x[0])) for s in shares]
                columns = [*(batch.column(n) for n in names_), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in s] for s in sets], kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names_, "lang_pred", "score", "languages"])

    out = taken.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names_, keep)], "lang_pred", "score", "languages")
