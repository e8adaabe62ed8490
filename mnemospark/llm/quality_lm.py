"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters (white space runs count as one space) of order ``order``.  Counts come from every trusted
document: each task sums its distinct n-grams before the shuffle, the shuffle adds them up.  Lower orders count
distinct left neighbours; discounts come from the counts of counts of each order; all of this is grouped tables joined
by n-gram, context and suffix.

Scoring joins documents with the model shard by shard.  A shard holds every n-gram whose last two context characters
hash to it, with all its contexts and suffixes, so a character's probability is found inside one shard; the two lowest
orders are in all of them.  The number of shards follows the counted size of the model, so one shard always fits the
bound, is broadcast on its own and joined with the n-grams of every document where it lies; the shards' sums are added
per document.  Texts never move.

Limits are calibrated on text that the model has not seen: texts are dealt into two halves by their hash, and every
document is scored by the model of the other half's trusted documents.  Two values are compared with a quantile of the
language's trusted documents: the log perplexity, less an allowance for short texts, whose mean is uncertain, and that
of the second worst word (of ``WORD_CHARS`` characters or more), as insults in a long text don't move its mean; one odd
word may be a name.  Languages with fewer than ``LEAST`` trusted documents use the quantile of all.  Quantiles come from histograms with bins of a
thousandth, so they are exact to a bin whatever the partitions; a margin of a twentieth is for what few trusted documents
leave out.  If one half has no trusted text, all of it is the model.

With more than one shard the sums of a document's words travel, four bytes a word and shard; else only its two values.

Defined results: null, empty and blank texts have no perplexity and are not kept; without any trusted document all
others are kept; a null language is its own group; repeated rows are scored each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, map_batches, slices, texts_of

PAD = "\n"  # stands before a text; cannot occur in a normalised one
#: Rows of the model in one broadcast shard; bytes of text whose n-grams are counted at once.
SHARD_ROWS, COUNT_BYTES = 2_000_000, 8 << 20
LEAST, BINS = 20, 1000
#: Words of so many characters, with the space behind them, are looked at one by one.
WORD_CHARS = 5


def normalise(text: str) -> str:
    return " ".join(text.split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def count_grams(texts: list[str], order: int, at_once: int = 1_000_000) -> tuple[list[str], np.ndarray]:
    """Distinct n-grams of the padded texts and their counts; characters are packed into 64 bits, a million at once."""
    parts, part, size = [], [], 0
    for t in texts:
        if t:
            part.append(t)
            size += len(t)
            if size >= at_once:
                parts.append(part)
                part, size = [], 0
    parts = [_codes("".join(PAD * (order - 1) + t for t in p)) for p in [*parts, part] if p]
    if not parts:
        return [], np.zeros(0, np.int64)
    alphabet = np.unique(np.concatenate([np.unique(p) for p in parts]))
    bits = max(1, int(alphabet.size - 1).bit_length())
    if bits * order > 63:  # too many characters to pack: one by one
        from collections import Counter

        c = Counter(t[i : i + order] for t in (PAD * (order - 1) + t for t in texts if t) for i in range(len(t) - order + 1))
        return list(c), np.array(list(c.values()), np.int64)
    pad = int(np.searchsorted(alphabet, ord(PAD)))
    keys, times = [], []
    for p in parts:
        ids = np.searchsorted(alphabet, p).astype(np.uint64)
        key = np.zeros(p.size - order + 1, np.uint64)
        for k in range(order):
            key = (key << np.uint64(bits)) | ids[k : k + key.size]
        found, counts = np.unique(key[ids[order - 1 :] != pad], return_counts=True)  # no n-gram ends in padding
        keys.append(found)
        times.append(counts)
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate(times), minlength=found.size).astype(np.int64)
    mask = np.uint64((1 << bits) - 1)
    chars = np.stack([alphabet[((found >> np.uint64(bits * (order - 1 - k))) & mask).astype(np.int64)] for k in range(order)], axis=1)
    return [x.tobytes().decode("utf-32-le", "surrogatepass") for x in np.ascontiguousarray(chars.astype("<u4"))], counts


def gram_counts(trusted: DataFrame, order: int, text_col: str = "text") -> DataFrame:
    """(g, c): every n-gram of the trusted texts, summed in each batch and again before the shuffle."""

    def run(batches):
        for b in slices(batches, COUNT_BYTES):
            if b.num_rows:
                grams, counts = count_grams([normalise(t) for t in texts_of(b)], order)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["g", "c"])

    return map_batches(trusted.select(F.col(f"`{text_col}`").alias("text")), run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts; defaults where these are degenerate."""
    n = level.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def model_tables(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame | None]]:
    """For each order from 1 up: (g, p) of its n-grams, and (h, b) of their contexts with the weight of what backs off."""
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = cut(levels[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c")), "level")
    out: list[tuple[DataFrame, DataFrame | None]] = []
    size = levels[1].count() + 1
    lower = None
    for n in range(1, order + 1):
        d1, d2, d3 = discounts(levels[n])
        c = F.col("c")
        off = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = F.substring("g", 1, n - 1) if n > 1 else F.lit("")
        rows = levels[n].select("g", context.alias("h"), "c", off.alias("off"))
        totals = rows.groupBy("h").agg(F.sum("c").alias("total"), F.sum("off").alias("held")).select("h", "total", (F.col("held") / F.col("total")).alias("b"))
        joined = rows.join(totals, "h")
        if n == 1:
            table = joined.select("g", ((c - F.col("off")) / F.col("total") + F.col("b") / size).alias("p"))
            unknown = totals.select(F.lit("").alias("g"), (F.col("b") / size).alias("p"))
            table = table.unionByName(unknown)
            weights = None
        else:
            below = lower.select(F.col("g").alias("s"), F.col("p").alias("q"))
            table = joined.withColumn("s", F.substring("g", 2, n - 1)).join(below, "s").select("g", ((c - F.col("off")) / F.col("total") + F.col("b") * F.col("q")).alias("p"))
            weights = totals.select("h", "b")
        lower = cut(table, "order")
        out.append((lower, weights))
    return out


class Hashed:
    """A map from 64-bit keys to floats for whole arrays of keys at once: open addressing with linear probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * keys.size).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.zeros(1 << self.bits, np.float32)
        at, left = self._slot(keys), np.arange(keys.size)
        self.probes = 0
        while left.size:
            self.probes += 1
            free = self.keys[at[left]] == np.iinfo(np.uint64).max
            slots, first = np.unique(at[left[free]], return_index=True)
            took = left[free][first]
            self.keys[slots], self.values[slots] = keys[took], values[took]
            left = np.setdiff1d(left, took, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether there is one) of every key."""
        at = self._slot(keys)
        here = self.keys[at]
        found, out = here == keys, self.values[at]
        open_ = np.flatnonzero(~found & (here != np.iinfo(np.uint64).max))
        for _ in range(self.probes):
            if not open_.size:
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            here = self.keys[at[open_]]
            hit = here == keys[open_]
            out[open_[hit]], found[open_[hit]] = self.values[at[open_[hit]]], True
            open_ = open_[~hit & (here != np.iinfo(np.uint64).max)]
        return out, found


class Shard:
    """The part of the model for the contexts that end in some pairs of characters."""

    def __init__(self, order: int, number: int, shards: int, grams: list[tuple[list[str], np.ndarray]], contexts: list[tuple[list[str], np.ndarray]]):
        self.order, self.number, self.shards = order, number, shards
        names, p = grams[0]
        self.unknown = float(np.log(p[names.index("")]))
        known = sorted(x for x in names if x)
        self.alphabet = np.array([ord(x) for x in known] + [ord(PAD)], np.uint32)
        order_ = np.argsort(self.alphabet)
        self.alphabet = self.alphabet[order_]
        own = dict(zip(names, np.log(p), strict=True))
        self.uni = np.array([self.unknown] + [own.get(chr(a), self.unknown) for a in self.alphabet], np.float32)
        self.grams = [None, *(Hashed(self._keys(g), np.log(v)) for g, v in grams[1:])]
        self.contexts = [None, *(Hashed(self._keys(g), np.log(v)) for g, v in contexts[1:])]

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of characters, 0 for those outside the alphabet."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), self.alphabet.size - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).astype(np.uint64)

    def _keys(self, grams: list[str]) -> np.ndarray:
        if not grams:
            return np.zeros(0, np.uint64)
        ids = self.ids(_codes("".join(grams))).reshape(len(grams), -1)
        key = np.zeros(len(grams), np.uint64)
        for k in range(ids.shape[1]):
            key = key * np.uint64(1 << 16) + ids[:, k] if self.order <= 4 else key * np.uint64(0x100000001B3) + ids[:, k] + np.uint64(1)
        return key

    def score(self, texts: list[str]) -> np.ndarray:
        """Summed log probability of the characters that fall to this shard, for each normalised text."""
        return self.score_words(texts)[0]

    def score_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same, and for each word of enough characters its text, its log probability here and its characters."""
        n = self.order
        joined = _codes("".join(PAD * (n - 1) + t for t in texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return np.zeros(len(texts)), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        table = np.zeros(int(joined.max()) + 1, np.uint64)
        inside = self.alphabet[self.alphabet < table.size]
        table[inside] = np.arange(1, inside.size + 1, dtype=np.uint64)
        ids = table[joined]
        begin = np.cumsum(sizes + n - 1) - sizes
        at = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        doc = np.repeat(np.arange(len(texts)), sizes)
        # a word begins with its text or behind a space
        word = np.cumsum((joined[at - 1] == ord(" ")) | (joined[at - 1] == ord(PAD))) - 1
        length, of = np.bincount(word), doc[np.concatenate(([True], word[1:] != word[:-1]))]
        if self.shards > 1:
            mine = shard_of(joined[at - 2], joined[at - 1], self.shards) == self.number
            at, doc, word = at[mine], doc[mine], word[mine]
        total = np.zeros(at.size, np.float32)
        left = np.arange(at.size)
        for k in range(n, 1, -1):
            if not left.size:
                break
            x = at[left]
            context = np.zeros(x.size, np.uint64)
            for j in range(k - 1, 0, -1):
                context = context * np.uint64(1 << 16) + ids[x - j] if n <= 4 else context * np.uint64(0x100000001B3) + ids[x - j] + np.uint64(1)
            key = context * np.uint64(1 << 16) + ids[x] if n <= 4 else context * np.uint64(0x100000001B3) + ids[x] + np.uint64(1)
            p, found = self.grams[k - 1].get(key)
            total[left[found]] += p[found]
            left = left[~found]
            b, there = self.contexts[k - 1].get(context[~found])
            total[left] += np.where(there, b, np.float32(0))
        total[left] += self.uni[ids[at[left]].astype(np.int64)]
        long = length >= WORD_CHARS
        return np.bincount(doc, total, minlength=len(texts)), of[long], np.bincount(word, total, minlength=length.size)[long], length[long]


def shard_of(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a pair of characters, from their code points."""
    return (a.astype(np.int64) * 31 + b.astype(np.int64) * 1009) % shards


def shards(tables: list[tuple[DataFrame, DataFrame | None]], order: int, shard_rows: int = SHARD_ROWS):
    """The model, shard by shard; n-grams of more than two characters are dealt, the others are in all."""
    rows = sum(t.count() for t, _ in tables)
    n = max(1, math.ceil(rows / shard_rows))
    for k in range(n):

        def part(t: DataFrame, width: int, context: bool, k=k) -> tuple[list[str], np.ndarray]:
            name, value = t.columns
            if n > 1 and width > 2:
                last = width - 1 if context else width - 2
                t = t.where((F.ascii(F.substring(name, last, 1)) * 31 + F.ascii(F.substring(name, last + 1, 1)) * 1009) % n == k)
            got = t.toArrow()
            return got.column(0).to_pylist(), got.column(1).to_numpy()

        grams = [part(t, i + 1, False) for i, (t, _) in enumerate(tables)]
        contexts = [([], np.zeros(0)) if w is None else part(w, i, True) for i, (_, w) in enumerate(tables)]
        yield Shard(order, k, n, grams, contexts)


def perplexities(docs: DataFrame, trusted: DataFrame, *, text_col: str = "text", order: int = 4, shard_rows: int = SHARD_ROWS, carry: tuple[str, ...] = (), held: list | None = None) -> DataFrame | None:
    """``held`` gets the shards' broadcasts, to be destroyed once the result is written.

    ``carry`` columns, the log perplexity (null for blank texts), the second worst word's and the characters of every row; None without trusted text."""
    counts = cut(gram_counts(trusted, order, text_col), "grams")
    if counts.isEmpty():
        return None
    parts, spark = [], docs.sparkSession
    picked = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text_col}`").alias("text"))
    kinds = dict(picked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", _text long, _score double, _chars long, _worst double, _words array<float>"
    for shard in shards(model_tables(counts, order), order, shard_rows):
        shared = spark.sparkContext.broadcast(shard)
        if held is not None:
            held.append(shared)

        def run(batches, shared=shared):
            own = shared.value
            for b in slices(batches):
                texts = [normalise(t) for t in texts_of(b, "text")]
                sizes = np.array([len(t) for t in texts])
                score, worst, a = np.zeros(len(texts)), np.full(len(texts), -np.inf), 0
                sums, edges = [np.zeros(0, np.float32)], [0]
                while a < len(texts):  # about half a million characters at once
                    z = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), 500_000)) + a)
                    score[a:z], of, p, length = own.score_words(texts[a:z])
                    mean = -p / length
                    if own.shards == 1:
                        order_ = np.lexsort((-mean, of))
                        of, mean = of[order_], mean[order_]
                        second = np.flatnonzero(of[1:] == of[:-1]) + 1
                        second = second[(second == 1) | (of[second - 2] != of[second])]
                        worst[of[second] + a] = mean[second]
                    else:
                        sums.append(mean.astype(np.float32))
                        edges += (edges[-1] + np.cumsum(np.bincount(of, minlength=z - a))).tolist()
                    a = z
                words = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(sums))) if own.shards > 1 else pa.nulls(len(texts), pa.list_(pa.float32()))
                keys = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
                values = [pa.array(keys), pa.array(score), pa.array(sizes, pa.int64()), pa.array(worst, mask=np.isneginf(worst)), words]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), *values], names=[*carry, "_text", "_score", "_chars", "_worst", "_words"])

        parts.append(map_batches(picked, run, schema))
    out = parts[0]
    if len(parts) > 1:
        # rows that repeat are one in each shard, and every row is returned
        key = [*(f"`{c}`" for c in carry), "_text"]
        ones = [p.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("_score", "_chars", "_words")), F.count("*").alias("_times")) for p in parts]
        out = ones[0]
        for p in ones[1:]:
            out = out.unionByName(p)
        out = out.groupBy(*key).agg(F.sum("_score").alias("_score"), F.max("_chars").alias("_chars"), F.max("_times").alias("_times"), F.collect_list("_words").alias("_lists"))
        summed = F.aggregate(F.slice("_lists", 2, len(parts)), F.get("_lists", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
        out = out.withColumn("_worst", F.get(F.sort_array(summed, False), F.lit(1)).cast("double")).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select(*(F.col(f"`{c}`") for c in carry), F.when(F.col("_chars") > 0, -F.col("_score") / F.col("_chars")).alias("log_ppl"), F.col("_worst").alias("worst"), F.col("_chars").alias("chars"))


def thresholds(scores: DataFrame, quantile: float, margin: float) -> DataFrame:
    """(lang, cut) from (lang, log_ppl) of trusted documents; lang null stands for itself, '' for all together."""
    bins = scores.where("log_ppl is not null").groupBy("lang", F.floor(F.col("log_ppl") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    every = bins.select(F.struct("lang").alias("k"), "bin", "n").unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("struct<lang:string>").alias("k"), "bin", "n"))
    lists = every.groupBy("k").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    # at most 20 thousand bins a language
    upto = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["at"], F.when(s["seen"] + x["n"] >= F.ceil(F.col("total") * quantile), x["bin"])).alias("at")))
    return lists.select(F.col("k.lang").alias("lang"), F.col("k").isNull().alias("all"), "total", ((upto["at"] + 1) / BINS + math.log(margin)).alias("cut"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, quantile: float = 0.99, margin: float = 1.05, allowance: float = 2.0, shard_rows: int = SHARD_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang, perplexity, threshold, kept, and ``carry``) for every row of ``docs``.

    The limit of the mean log perplexity is that of the language plus ``allowance`` over the root of the length; a row
    whose second worst word lies above the language's limit for words isn't kept either.

    Trusted are the documents that ``labels`` calls of quality 1 and not toxic.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select(F.col("doc_id").alias(id_col))
    good = broadcast_if_small(good, good.count(), 16)
    slim = docs.select(*dict.fromkeys((id_col, text_col, lang_col, *carry)))
    marked = slim.join(good.withColumn("trusted", F.lit(True)), id_col, "left")
    half = F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(2))
    held: list = []
    dealt, spread = [], {"text_col": text_col, "order": order, "shard_rows": shard_rows, "carry": (id_col, lang_col, "trusted", *carry), "held": held}
    for k in (0, 1):
        own = marked.where(half == k)
        part = perplexities(own, marked.where("trusted").where(half != k), **spread)
        dealt.append(perplexities(own, marked.where("trusted"), **spread) if part is None else part)
    scored = None if None in dealt else dealt[0].unionByName(dealt[1])
    if scored is None:
        blank = F.coalesce(F.length(F.trim(F.regexp_replace(F.col(f"`{text_col}`"), r"\s+", " "))), F.lit(0)) == 0
        return docs.select(id_col, F.col(lang_col).alias("lang"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (~blank).alias("kept"), *carry)
    scored = cut(scored, "scores")
    for shared in held:
        shared.destroy()
    spare = F.when(F.col("chars") > 0, allowance / F.sqrt(F.greatest("chars", F.lit(1)))).otherwise(0.0)
    found = scored.withColumnRenamed(lang_col, "own_lang")
    for name, value in (("limit", F.col("log_ppl") - spare), ("word_limit", F.col("worst"))):
        limits = thresholds(scored.where("trusted").select(F.col(lang_col).alias("lang"), value.alias("log_ppl")), quantile, margin)
        general = limits.where("all").select(F.col("cut").alias("general"))
        own = limits.where(~F.col("all") & (F.col("total") >= LEAST)).select("lang", "cut")
        found = found.join(F.broadcast(own), F.col("own_lang").eqNullSafe(F.col("lang")), "left").drop("lang").join(F.broadcast(general), F.lit(True), "left").withColumn(name, F.coalesce("cut", "general")).drop("cut", "general")
    limit = F.col("limit") + spare
    fine = F.coalesce(F.col("log_ppl") <= limit, F.lit(False)) & F.coalesce(F.col("worst") <= F.col("word_limit"), F.lit(True))
    return found.select(id_col, F.col("own_lang").alias("lang"), F.exp("log_ppl").alias("perplexity"), F.exp(limit).alias("threshold"), fine.alias("kept"), *carry)
