"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is of word pairs; below them, as the distribution that a pair's discounted mass goes to, is a model
of the characters of a word, each between word marks, up to ``order`` characters long. Both are trained on every
word of every trusted document. Tasks count the distinct pairs and words of their block, and the counts of all
blocks are summed by Spark: those of pairs, which grow with the text, by parts, packed as arrays; those of character n-grams, which saturate, as rows whose discounts,
continuation counts and lower-order probabilities are count joins between the orders, by n-gram, context and suffix.

Scoring sends the pairs of each block of documents to their part, where the counts are, and adds the sums that
come back (see ``kn_pairs``); no row of the pair model reaches the driver but the sums of at most 65,536 frequent words. The model of
characters is broadcast in shards of about ``shard_rows`` rows, by the last two characters of a context (rows with shorter contexts
are in every shard).

A document is kept if its perplexity is at most ``slack`` times a threshold, which is set by the trusted documents of its
language that were held out of the training: the middle of their log perplexities plus a high quantile of how far above it they lie.
A short text says less about itself, so that distance is measured, and allowed, in units that grow as sqrt(1 + short_chars / n).
The figures of a language with few held-out documents lean on those of all languages: their weight is docs / (docs + least_docs).

Defined cases: null, empty and wordless texts have no perplexity and are kept; a null language is
a language of its own; without trusted rows nothing can be judged and everything is kept; repeated
rows each get their own result row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import fresh_names, frugal, staged, text_blocks
from caseloom.llm.kn_pairs import Frequent, discounts_of, frequent_words, part_bits, score, word_counts
from caseloom.llm.kn_words import Words, keys_of, word_keys

ORDER, SHARD_ROWS, QUANTILE, SLACK, LEAST_DOCS, SHORT_CHARS = 5, 4_000_000, 0.995, 1.0, 30, 80
BROADCAST_IDS = 2_000_000
#: Bytes of text whose words are tabled at a time.
BLOCK = 2 << 20


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents labelled as good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(f"`{id_col}`").alias("trusted_id")).filter("trusted_id is not null").distinct()


def with_trust(docs: DataFrame, labels: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, text, lang, trusted); ids are broadcast up to ``broadcast_ids`` of them, else the join is shuffled."""
    ids = trusted_ids(labels)
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"))
    return d.join(ids, d["doc_id"] == ids["trusted_id"], "left").select("doc_id", "text", "lang", F.col("trusted_id").isNotNull().alias("trusted"))


def held_back(id_col: Column) -> Column:
    """A tenth of the trusted documents sets the thresholds and is not trained on."""
    return F.crc32(id_col.cast("string")) % 10 == 0


def ngram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c): of each word's places the longest n-gram that ends there, summed over all of ``texts`` (column text)."""

    def run(batches):
        for b in (part for batch in batches for part in text_blocks(batch, "text", BLOCK)):
            words = pc.ascii_split_whitespace(b.column(0).cast(pa.string())).flatten()
            found = words.filter(pc.not_equal(words, "")).value_counts()  # white space at an end leaves an empty word
            w = Words(found.field(0))
            if not len(w.points):
                continue
            weight = found.field(1).to_numpy(zero_copy_only=False)[w.word]
            keys = w.hashes(order)
            for k in range(2, order + 1):
                at = np.flatnonzero(w.place >= order - 1 if k == order else w.place == k - 1)
                if not len(at):
                    continue
                _, first, inverse = np.unique(keys[k - 1][at], return_index=True, return_inverse=True)
                at_first = at[first]
                grams = np.ascontiguousarray(w.points[at_first[:, None] + np.arange(1 - k, 1)]).view(f"<U{k}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), pa.array(np.bincount(inverse, weight[at]).astype(np.int64))], ["gram", "c"])

    return texts.select("text").mapInArrow(frugal(run), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of one order, from its counts of counts."""
    row = counts.agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    return discounts_of([float(x or 0) for x in row])


def train(texts: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """The model, (gram, kind, value), and the log probability of an unknown character.

    kind p: log of the interpolated probability of the n-gram's last character; kind b: log of the back-off
    weight of a context.
    """
    raw = staged(ngram_counts(texts, order), "counts").withColumn("k", F.length("gram"))
    levels = {order: raw.filter(F.col("k") == order).select("gram", "c")}
    for k in range(order - 1, 0, -1):  # continuation counts; n-grams at a word's begin have no continuation and keep their counts
        after = levels[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        levels[k] = staged(after.unionByName(raw.filter(F.col("k") == k).select("gram", "c")) if k > 1 else after, "level")
    lower, parts, unknown = None, [], 0.0
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(levels[k])
        c = levels[k].withColumn("context", F.expr(f"left(gram, {k - 1})"))
        many = lambda t: F.sum(t.cast("long"))
        context = c.groupBy("context").agg(F.sum("c").alias("total"), (d1 * many(F.col("c") == 1) + d2 * many(F.col("c") == 2) + d3 * many(F.col("c") >= 3)).alias("held"))
        left = F.col("c") - F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        if k == 1:
            one = context.first()
            if one is None:
                return levels[1].select("gram", F.lit("p").alias("kind"), F.lit(0.0).alias("value")).limit(0), 0.0
            unknown = one["held"] / one["total"] / (levels[1].count() + 1)
            p = c.select("gram", (left / F.lit(float(one["total"])) + F.lit(unknown)).alias("p"))
        else:
            p = c.join(context, "context").withColumn("suffix", F.expr("substring(gram, 2)")).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            p = p.select("gram", (left / F.col("total") + F.col("held") / F.col("total") * F.col("below")).alias("p"))
            parts.append(context.select(F.col("context").alias("gram"), F.lit("b").alias("kind"), F.log(F.col("held") / F.col("total")).alias("value")))
        lower = staged(p, "level")
        parts.append(lower.select("gram", F.lit("p").alias("kind"), F.log("p").alias("value")))
    model = parts[0]
    for x in parts[1:]:
        model = model.unionByName(x)
    return staged(model, "model"), math.log(unknown) if unknown > 0 else -30.0


def shard_of(a, b, shards: int):
    """The shard of a context whose last two characters are a and b (code points, as columns or arrays)."""
    return (a * 1_000_003 + b) % shards


class Table:
    """Sorted keys and their values; part of one shard."""

    def __init__(self, grams: pa.Array, values: pa.Array):
        keys = keys_of(grams)
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values.to_numpy(zero_copy_only=False)[by]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key; equal keys are looked up once."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        coded = pa.array(keys).dictionary_encode()
        once = coded.dictionary.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.keys, once), len(self.keys) - 1)
        back = coded.indices.to_numpy(zero_copy_only=False)
        return (self.keys[at] == once)[back], self.values[at][back]


def word_scores(words: pa.Array, p: Table, b: Table, unknown: float, order: int, shards: int, shard: int) -> np.ndarray:
    """The log probability of each word, over the places that belong to this shard."""
    w = Words(words)
    keys = w.hashes(order)
    at = np.flatnonzero(w.place > 0)
    if shards > 1:
        points = w.points.astype(np.int64)
        # A place with one character before it has its rows in every shard; shard 0 counts it.
        own = np.where(w.place[at] > 1, shard_of(points[at - 2], points[at - 1], shards), 0)
        at = at[own == shard]
    total = np.zeros(len(w.points))
    for k in range(order, 0, -1):
        can = w.place[at] + 1 >= k
        here = at[can]
        found, value = p.find(keys[k - 1][here])
        total[here[found]] += value[found]
        missed = here[~found]
        if k > 1:
            known, weight = b.find(keys[k - 2][missed - 1])
            total[missed[known]] += weight[known]
        else:
            total[missed] += unknown
        at = np.concatenate((at[~can], missed))
    return np.bincount(w.word, total, len(words))


class Spelling:
    """Log probabilities of words under the model of characters; its shards are broadcast."""

    def __init__(self, model: DataFrame, unknown: float, order: int = ORDER, shard_rows: int = SHARD_ROWS):
        self.unknown, self.order = unknown, order
        self.shards = max(1, -(-model.count() // shard_rows))
        context = F.when(F.col("kind") == "b", F.col("gram")).otherwise(F.expr("left(gram, length(gram) - 1)"))
        placed = model.withColumn("context", context).withColumn("shard", F.when(F.length("context") >= 2, shard_of(F.ascii(F.expr("right(context, 2)")).cast("long"), F.ascii(F.expr("right(context, 1)")), self.shards)).otherwise(-1))
        self.sent = []
        for s in range(self.shards):
            rows = placed.filter(F.col("shard").isin(s, -1)).select("gram", "kind", "value").toArrow()
            tables = [Table(t.column("gram").combine_chunks(), t.column("value").combine_chunks()) for t in (rows.filter(pc.equal(rows["kind"], kind)) for kind in "pb")]
            self.sent.append(model.sparkSession.sparkContext.broadcast([(t.keys, t.values) for t in tables]))
        self.frequent = Frequent(model.sparkSession, [], np.zeros(0, np.uint64), np.zeros(0))

    def with_frequent(self, texts: DataFrame) -> Spelling:
        """Gives short ids to the most frequent words of ``texts``."""
        words = frequent_words(texts)
        if words:
            given = pa.array(words, pa.string())
            self.frequent = Frequent(texts.sparkSession, words, word_keys(given), self(given))
        return self

    def __call__(self, words: pa.Array) -> np.ndarray:
        total = np.zeros(len(words))
        for s, sent in enumerate(self.sent):
            p, b = (Table.__new__(Table) for _ in range(2))
            for t, (t.keys, t.values) in zip((p, b), sent.value):
                pass
            total += word_scores(words, p, b, self.unknown, self.order, self.shards, s)
        return total


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK, least_docs: int = LEAST_DOCS, short_chars: int = SHORT_CHARS, shard_rows: int = SHARD_ROWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Per row: doc_id, text_key, lang, n_chars_scored, perplexity, threshold, kept."""
    d = with_trust(docs, labels, broadcast_ids)
    texts = d.filter(F.col("trusted") & ~held_back(F.col("doc_id")))
    spelling = Spelling(*train(texts, order), order, shard_rows).with_frequent(texts)
    d = d.withColumn("text_key", F.xxhash64("text"))
    bits = part_bits(d)
    scored = staged(score(d, staged(word_counts(texts, spelling, bits), "pairs"), spelling, bits), "scores")
    scored = scored.withColumn("size", F.log("perplexity")).withColumn("spread", F.sqrt(1 + short_chars / F.greatest("n", F.lit(1))))
    fair = scored.filter(F.col("trusted") & held_back(F.col("doc_id")) & F.col("perplexity").isNotNull())
    own = F.col("docs") / (F.col("docs") + F.lit(float(least_docs)))

    def level(df, value, share):
        """``value`` at ``share`` of the held-out documents, of each language and of all."""
        at = lambda name: F.percentile_approx(value, share, 100_000).alias(name)
        return staged(df.groupBy("lang").agg(at("own"), F.count("*").alias("docs")), "levels"), df.agg(at("all_langs"))

    def with_level(df, levels, name):
        """A language's level counts the more, the more documents it is from."""
        each, overall = levels
        d = df.join(each, "lang", "left").crossJoin(F.broadcast(overall))  # one row; the other is a table of known size, broadcast if it is small
        return d.withColumn(name, F.coalesce(own * F.col("own") + (1 - own) * F.col("all_langs"), "all_langs")).drop("own", "docs", "all_langs")

    middle = level(fair, F.col("size"), 0.5)
    fair = with_level(fair, middle, "middle").withColumn("off", (F.col("size") - F.col("middle")) / F.col("spread"))
    d = with_level(with_level(scored, middle, "middle"), level(fair, F.col("off"), quantile), "most")
    limit = F.exp(F.col("middle") + F.col("most") * F.col("spread") + 1e-9) * slack
    return d.select("doc_id", "text_key", "lang", F.col("n").alias("n_chars_scored"), "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    id_, key = fresh_names(docs, "id", "key")
    bad = classify(docs, labels, **kw).filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    bad = staged(bad, "bad")  # of known size: if it is small Spark sends it to the documents and leaves their texts where they are
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (own == F.col(key)), "left_anti")
