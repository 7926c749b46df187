"""Hashed features, scores of windows and best phrases in the tasks that read the texts: Arrow batches, numpy, no row leaves its task.

Spark cuts tokens (`feature_tokens`, a blank between words where windows count words); here their hashes are continued over code
points for all tokens of a slice at once. FNV-1a's last 18 bits depend on no higher ones, so 18 bits are kept. Everything takes
texts whose doc_id is their own (`single`); the operators in `detector` and `intervals` do the same by joins for any."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.lexicons import STOPWORDS

BITS = 18
MASK = np.uint32((1 << BITS) - 1)
PRIME = np.uint32(16777619)
#: Tokens of a slice; a longer text is a slice of its own.
SLICE = 150_000


def single(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    return docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def raw_tokens(text: Column, pattern: str = T.FEATURE_TOKEN) -> Column:
    return T.matches(F.replace(F.lower(text), F.lit("’"), F.lit("'")), pattern)


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, words (null): texts as they are."""
    return docs.select("doc_id", raw_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), F.lit(None).cast("int").alias("words"))


def by_words(docs: DataFrame, words: Column, lengths: Column | None = None) -> DataFrame:
    """doc_id, tokens, words(, lengths): the tokens of words joined by blanks, with the blanks, and how many words there are."""
    cut = T.let(words, lambda w: F.struct(raw_tokens(F.array_join(w, " "), f"{T.FEATURE_TOKEN}| ").alias("tokens"), F.size(w).alias("words")))
    more = [] if lengths is None else [lengths.alias("lengths")]
    return docs.select("doc_id", cut.alias("x"), *more).select("doc_id", "x.tokens", "x.words", *(["lengths"] if more else []))


def start(prefix: str) -> np.uint32:
    h = 2166136261
    for c in prefix:
        h = (h ^ ord(c)) * 16777619 % (1 << 32)
    return np.uint32(h & int(MASK))


class Words:
    """Distinct tokens with their code points, numbers as one."""

    def __init__(self, words: pa.Array):
        words = pc.if_else(pc.match_substring_regex(words, r"^[0-9]+$"), "<num>", words)
        words = pa.concat_arrays([words.cast(pa.string()), pa.array(["_", " "], pa.string())])
        self.words, self.size = words, np.asarray(pc.utf8_length(words)).astype(np.int64)
        self.blank = len(words) - 2
        self.at = np.cumsum(self.size) - self.size
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        self.points = np.frombuffer(words.buffers()[2].to_pybytes()[ends[0] : ends[-1]].decode().encode("utf-32-le"), np.uint32)
        keep = pc.or_(pc.is_in(words, value_set=pa.array(STOPWORDS)), pc.invert(pc.match_substring_regex(words, r"\pL")))
        self.shape = np.where(np.asarray(keep), np.arange(len(words)), self.blank)

    def all(self) -> np.ndarray:
        return np.arange(len(self.words))

    def fold(self, h: np.ndarray, which: np.ndarray) -> np.ndarray:
        """h continued over the code points of the words numbered `which`."""
        h, left, at = h.copy(), self.size[which], self.at[which]
        live, k = np.flatnonzero(left > 0), 0
        with np.errstate(over="ignore"):
            while live.size:
                h[live] = ((h[live] ^ self.points[at[live] + k]) * PRIME) & MASK
                k += 1
                live = live[left[live] > k]
        return h

    def after(self, prefix: str) -> np.ndarray:
        """The state after the prefix and each word."""
        return self.fold(np.full(len(self.words), start(prefix), np.uint32), self.all())

    @staticmethod
    def space(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h ^ np.uint32(32)) * PRIME) & MASK


class Slice:
    """Texts of consecutive rows. codes: their tokens, numbers into words; first, last: places of each row's; word: which word a token is in."""

    def __init__(self, rows: range, tokens: pa.Array, lengths: np.ndarray, words: np.ndarray | None):
        self.rows, self.n_words = rows, words
        d = tokens.dictionary_encode()
        codes = np.asarray(d.indices).astype(np.int64)
        self.words = Words(d.dictionary)
        row = np.repeat(np.arange(len(lengths)), lengths)
        if words is not None:
            blank = np.asarray(pc.equal(d.dictionary, " "))[codes] if len(codes) else np.zeros(0, bool)
            count = np.cumsum(blank)
            edge = np.cumsum(lengths) - lengths
            before = np.concatenate([[0], count])[edge]
            self.word = (count - before[row])[~blank]
            codes, row = codes[~blank], row[~blank]
        self.codes, self.row = codes, row
        self.last = np.searchsorted(row, np.arange(len(lengths)), "right")
        self.first = np.searchsorted(row, np.arange(len(lengths)), "left")

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: itself, it with the next one, the function words around it with the two next ones, and whether there are any."""
        w, c = self.words, self.codes
        s = w.shape[c]
        two = w.fold(w.space(w.after("b:"))[c[:-1]], c[1:])
        three = w.fold(w.space(w.fold(w.space(w.after("f:"))[s[:-2]], s[1:-1])), s[2:])
        some = (s[:-2] != w.blank) | (s[1:-1] != w.blank) | (s[2:] != w.blank)
        return w.after("u:")[c], two, three, some

    def windows(self, size: int, step: int) -> tuple[np.ndarray, ...]:
        """(row, number, first word, word after the last) of windows of `size` words every `step` words; the last one reaches the end."""
        n = self.n_words
        many = np.where(n > 0, np.maximum(-(-(n - size) // step), 0) + 1, 0)
        row = np.repeat(np.arange(len(n)), many)
        ix = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return row, ix, ix * step, np.minimum(ix * step + size, n[row])

    def tokens_of(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of words lo to hi of rows."""
        far = int(max(self.word.max(initial=0), hi.max(initial=0))) + 2
        key = self.row * far + self.word
        return np.searchsorted(key, row * far + lo), np.searchsorted(key, row * far + hi)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all places of ranges."""
    n = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) + np.repeat(lo - (np.cumsum(n) - n), n)


def counted(s: Slice, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, h, count), sorted, of pieces given by ranges of tokens."""
    one, two, three, some = s.hashes()
    parts = []
    for h, less in ((one, 0), (two, 1), (three, 2)):
        owner, at = ranges(lo, hi - less)
        if less == 2:
            owner, at = owner[some[at]], at[some[at]]
        parts.append(owner << BITS | h[at].astype(np.int64))
    keys = np.concatenate(parts)
    keys.sort()
    cut = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[cut] >> BITS, keys[cut] & int(MASK), np.diff(cut, append=len(keys))


def summed(piece: np.ndarray, x: np.ndarray, pieces: int) -> np.ndarray:
    return np.bincount(piece, x, pieces)


def logits(s: Slice, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of each piece's features without the bias, nan where there are none."""
    piece, h, c = counted(s, lo, hi)
    v = np.log1p(c)
    with np.errstate(invalid="ignore", divide="ignore"):
        norm = np.sqrt(summed(piece, v * v, len(lo)))
        return np.where(norm > 0, summed(piece, v / norm[piece] * weights[h], len(lo)), np.nan)


def in_tasks(df: DataFrame, schema: str, work: Callable[[Slice, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """What work(slice, its rows) gives for df (doc_id, tokens, words, ...)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lengths = np.asarray(pc.list_value_length(b.column("tokens"))).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(lengths)])
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(total, total[i] + SLICE, "right")) - 1)
                part = b.slice(i, j - i)
                words = None if part.column("words").null_count else np.asarray(part.column("words")).astype(np.int64)
                out = work(Slice(range(i, j), part.column("tokens").flatten(), lengths[i:j], words), part)
                yield pa.RecordBatch.from_arrays(out, names)
                i = j

    return df.mapInArrow(run, schema)


def ids(part: pa.RecordBatch, row: np.ndarray) -> pa.Array:
    return part.column("doc_id").take(pa.array(row))


def id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, h, c, value: counts of each row's features and their logarithms of unit length."""
    def work(s: Slice, part: pa.RecordBatch) -> list[pa.Array]:
        piece, h, c = counted(s, s.first, s.last)
        v = np.log1p(c)
        norm = np.sqrt(summed(piece, v * v, len(s.first)))
        return [ids(part, piece), pa.array(h), pa.array(c.astype(np.int64)), pa.array(v / norm[piece])]

    return in_tasks(whole(docs), f"doc_id {id_type(docs)}, h long, c long, value double", work)


def feature_sums(docs: DataFrame, prime: int = 97) -> DataFrame:
    """doc_id, features, h_sum, checksum, norm of each text that has features."""
    def work(s: Slice, part: pa.RecordBatch) -> list[pa.Array]:
        piece, h, c = counted(s, s.first, s.last)
        n, v = len(s.first), np.log1p(c)
        v = v / np.sqrt(summed(piece, v * v, n))[piece]
        features = np.bincount(piece, minlength=n)
        has = np.flatnonzero(features)
        return [ids(part, has), pa.array(features[has]), pa.array(summed(piece, h, n)[has].astype(np.int64)), pa.array(summed(piece, v * (h % prime), n)[has]), pa.array(summed(piece, v * v, n)[has])]

    return in_tasks(whole(docs), f"doc_id {id_type(docs)}, features long, h_sum long, checksum double, norm double", work)


def label_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """h, c1, c0: in how many labelled texts a feature is, by y (labels: doc_id, y). A task gives one row for each feature it has."""
    d = docs.join(labels, "doc_id")
    t = d.select("doc_id", raw_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), F.lit(None).cast("int").alias("words"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            lengths = np.asarray(pc.list_value_length(b.column("tokens"))).astype(np.int64)
            upto, i = np.concatenate([[0], np.cumsum(lengths)]), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLICE, "right")) - 1)
                s = Slice(range(i, j), b.column("tokens").slice(i, j - i).flatten(), lengths[i:j], None)
                piece, h, _ = counted(s, s.first, s.last)
                y = b.column("y").slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)[piece]
                total[1] += np.bincount(h[y], minlength=1 << BITS)
                total[0] += np.bincount(h[~y], minlength=1 << BITS)
                i = j
        h = np.flatnonzero(total.sum(0))
        for k in range(0, len(h), 10_000):
            at = h[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1][at]), pa.array(total[0][at])], ["h", "c1", "c0"])

    return t.mapInArrow(run, "h long, c1 long, c0 long").groupBy("h").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def vector(weights: DataFrame) -> np.ndarray:
    """Weights (h, w; at most 2^18 rows) as an array, 0 where there is none."""
    w = np.zeros(1 << BITS)
    t = weights.select("h", "w").toArrow()
    w[np.asarray(t["h"])] = np.asarray(t["w"])
    return w


def text_logits(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, logit, probability of each text that has features."""
    def work(s: Slice, part: pa.RecordBatch) -> list[pa.Array]:
        z = logits(s, s.first, s.last, weights) + bias
        has = np.flatnonzero(~np.isnan(z))
        return [ids(part, has), pa.array(z[has]), pa.array(1 / (1 + np.exp(-z[has])))]

    return in_tasks(whole(docs), f"doc_id {id_type(docs)}, logit double, probability double", work)


def best_phrases(docs: DataFrame, weights: np.ndarray, most: int) -> DataFrame:
    """doc_id, phrase, w: the `most` words and pairs of each text with the greatest weights over 0, phrases in order where weights are one.

    A phrase's order is that of its words: no token has a character below the blank that parts them."""
    def work(s: Slice, part: pa.RecordBatch) -> list[pa.Array]:
        w, c = s.words, s.codes
        text = w.words
        # one number for equal words: numbers of several forms are one token
        rank = np.asarray(pc.rank(pc.cast(text, pa.binary()), tiebreaker="min")).astype(np.int64)
        alone = np.asarray(pc.match_substring_regex(text, r"^\pL{3,}$"))[c]
        opens = np.asarray(pc.match_substring_regex(text, r"^\pL"))
        one = weights[w.after("u:")][c]
        at = np.flatnonzero(alone & (one > 0))
        pair = opens[c[:-1]] & opens[c[1:]] & (s.row[:-1] == s.row[1:])
        p = np.flatnonzero(pair)
        two = weights[w.fold(w.space(w.after("b:"))[c[p]], c[p + 1])]
        p, two = p[two > 0], two[two > 0]
        row = np.concatenate([s.row[at], s.row[p]])
        a, b = np.concatenate([c[at], c[p]]), np.concatenate([np.full(len(at), -1), c[p + 1]])
        weight = np.concatenate([one[at], two])
        order = np.lexsort((np.where(b < 0, -1, rank[b]), rank[a], -weight, row))
        row, a, b, weight = row[order], a[order], b[order], weight[order]
        same = np.zeros(len(row), bool)
        rb = np.where(b < 0, -1, rank[b])
        same[1:] = (row[1:] == row[:-1]) & (rank[a[1:]] == rank[a[:-1]]) & (rb[1:] == rb[:-1])
        row, a, b, weight = row[~same], a[~same], b[~same], weight[~same]
        k = np.arange(len(row)) - np.searchsorted(row, row, "left")
        row, a, b, weight = row[k < most], a[k < most], b[k < most], weight[k < most]
        first, second = text.take(pa.array(a)), text.take(pa.array(np.maximum(b, 0)))
        phrase = pc.if_else(pa.array(b < 0, pa.bool_()), first, pc.binary_join_element_wise(first, second, " "))
        return [ids(part, row), phrase, pa.array(weight)]

    return in_tasks(whole(docs), f"doc_id {id_type(docs)}, phrase string, w double", work)


def window_probabilities(s: Slice, size: int, step: int, weights: np.ndarray, bias: float) -> tuple[np.ndarray, ...]:
    """(row, number, first word, word after the last, probability to four places; 0.5 without features) of windows."""
    row, ix, lo, hi = s.windows(size, step)
    z = logits(s, *s.tokens_of(row, lo, hi), weights) + bias
    p = 1 / (1 + np.exp(-z))
    return row, ix, lo, hi, np.where(np.isnan(z), 0.5, np.floor(p * 10_000 + 0.5) / 10_000)


def scored_windows(texts: DataFrame, size: int, step: int, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, words, ix, start, end, probability of windows of texts (by_words)."""
    def work(s: Slice, part: pa.RecordBatch) -> list[pa.Array]:
        row, ix, lo, hi, p = window_probabilities(s, size, step, weights, bias)
        return [ids(part, row), pa.array(s.n_words[row]), *map(pa.array, (ix, lo, hi, p))]

    return in_tasks(texts, f"doc_id {id_type(texts)}, words long, ix long, start long, end long, probability double", work)


def covers(at: np.ndarray, windows: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(last window, window before it or the same) that cover word `at` of a text with so many windows; size under twice the step."""
    hi = np.minimum(at // step, windows - 1)
    return hi, np.where((hi > 0) & (at < (hi - 1) * step + size), hi - 1, hi)


def covering_means(texts: DataFrame, size: int, step: int, weights: np.ndarray, bias: float, points: np.ndarray | None = None) -> DataFrame:
    """doc_id, pos, value: the mean of the windows over each word, or over words `points` only, to six places."""
    def work(s: Slice, part: pa.RecordBatch) -> list[pa.Array]:
        row, _, _, _, p = window_probabilities(s, size, step, weights, bias)
        first = np.searchsorted(row, np.arange(len(s.n_words)))
        many = np.bincount(row, minlength=len(s.n_words))
        if points is None:
            r, at = ranges(np.zeros(len(s.n_words), np.int64), s.n_words)
        else:
            r, at = np.repeat(np.arange(len(s.n_words)), len(points)), np.tile(points, len(s.n_words))
            r, at = r[at < s.n_words[r]], at[at < s.n_words[r]]
        hi, lo = covers(at, many[r], size, step)
        a, b = p[first[r] + lo], p[first[r] + hi]
        return [ids(part, r), pa.array(at.astype(np.int32)), pa.array(np.rint(np.where(lo == hi, b, (a + b) / 2) * 1e6) / 1e6)]

    return in_tasks(texts, f"doc_id {id_type(texts)}, pos int, value double", work)


def shares(texts: DataFrame, size: int, step: int, weights: np.ndarray, bias: float, block: int, bars: tuple[float, float, float]) -> DataFrame:
    """doc_id, words, ai, human, ai_passages: words by the mean of the windows over them; a passage ends with its block of words.

    bars: likely_ai, likely_ai of windows under 150 words, likely_human."""
    def work(s: Slice, part: pa.RecordBatch) -> list[pa.Array]:
        row, _, lo, hi, p = window_probabilities(s, size, step, weights, bias)
        docs = len(s.n_words)
        first, many = np.searchsorted(row, np.arange(docs)), np.bincount(row, minlength=docs)
        r, at = ranges(np.zeros(docs, np.int64), s.n_words)
        x, y = covers(at, many[r], size, step)
        a, b = first[r] + x, first[r] + y
        mean = np.where(a == b, p[a], (p[b] + p[a]) / 2)
        least = np.minimum(hi[a] - lo[a], hi[b] - lo[b])
        ai = mean >= np.where(least >= 150, bars[0], bars[1])
        human = ~ai & (mean <= bars[2])
        opens = np.ones(len(at), bool)
        kind = ai * 2 + human
        opens[1:] = (r[1:] != r[:-1]) | (kind[1:] != kind[:-1]) | (at[1:] // block != at[:-1] // block)
        some = np.flatnonzero(s.n_words > 0)
        n = lambda m: np.bincount(r[m], minlength=docs)[some]
        return [ids(part, some), *map(pa.array, (s.n_words[some], n(ai), n(human), n(ai & opens)))]

    return in_tasks(texts, f"doc_id {id_type(texts)}, words long, ai long, human long, ai_passages long", work)


def around_sentences(texts: DataFrame, size: int, step: int, weights: np.ndarray, bias: float, largest: bool) -> DataFrame:
    """doc_id, start, end, value(, overlap) of sentences of `texts` (by_words with lengths: words of each sentence, in order).

    value is that of the shortest window around a sentence, null if none; or with `largest` that of the window which shares most
    words with it, the first of equals, without sentences that no window meets."""
    def work(s: Slice, part: pa.RecordBatch) -> list[pa.Array]:
        row, _, lo, hi, p = window_probabilities(s, size, step, weights, bias)
        docs = len(s.n_words)
        first, many = np.searchsorted(row, np.arange(docs)), np.bincount(row, minlength=docs)
        lengths = part.column("lengths")
        per = np.asarray(pc.list_value_length(lengths)).astype(np.int64)
        n = np.asarray(lengths.flatten()).astype(np.int64)
        r = np.repeat(np.arange(docs), per)
        end = np.cumsum(n)
        end -= np.concatenate([[0], end])[np.cumsum(per) - per][r]
        r, st, en = r[n > 0], (end - n)[n > 0], end[n > 0]
        # windows that can meet a sentence
        least = np.minimum(np.maximum((st - size) // step, 0), many[r])
        owner, k = ranges(first[r] + least, first[r] + np.minimum((en - 1) // step + 1, many[r]))
        if largest:
            common = np.minimum(en[owner], hi[k]) - np.maximum(st[owner], lo[k])
            ok, best = common > 0, -common
        else:
            ok, best = (lo[k] <= st[owner]) & (en[owner] <= hi[k]), hi[k] - lo[k]
        owner, k, best = owner[ok], k[ok], best[ok]
        order = np.lexsort((lo[k], best, owner))
        owner, k, best = owner[order], k[order], best[order]
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        owner, k, best = owner[head], k[head], best[head]
        if largest:
            return [ids(part, r[owner]), pa.array(st[owner]), pa.array(en[owner]), pa.array(p[k]), pa.array(-best)]
        value, none = np.zeros(len(r)), np.ones(len(r), bool)
        value[owner], none[owner] = p[k], False
        return [ids(part, r), pa.array(st), pa.array(en), pa.array(value, mask=none)]

    return in_tasks(texts, f"doc_id {id_type(texts)}, start long, end long, value double" + (", overlap long" if largest else ""), work)
