"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a byte-context trie of order K (default 4): for every context of up to K bytes, how often each byte followed.
A symbol is coded in the longest context; if it wasn't seen there, an escape is coded and the next shorter context is
tried, without the symbols the longer one has seen (exclusion). Escapes are estimated by method C: with n occurrences
of d different symbols (after exclusion), a symbol seen c times has the probability c / (n + d), the escape d / (n + d).
Below order 0 the symbols not yet excluded are equally likely out of 256. Texts have A-Z lower-cased, K start marks (0xFF,
which UTF-8 never uses) before and one as the end symbol after them.

``pretrained``: the trie is learned from the training documents as a whole and then fixed. Spark gathers it as counts of
distinct (K+1)-grams: shorter contexts are sums of longer ones, since every place of a text has a full context. The cost
of a gram depends on its own chain of contexts only; grams that end their context in the same two bytes share all chains
down to order 2, so costs are worked out per such group, with the tables of orders 1 and 0 (65,536 cells at most) at
hand. A document's score is the sum of its grams' costs.
``adaptive``: each document is coded on its own with a trie that starts empty and learns as it goes.

The base score is a smoothed unigram model over words and an end token, learned from the same documents.

Tables of costs and word counts are split: the most frequent ``max_table`` keys (a fixed bound, by default a million words and
four million grams) are sent to the tasks; what a document holds beyond those is listed as (key, count), joined with
the rest of the table by key, and added to the document. Both ways give the same sums.

Defined cases: null and empty texts have the end symbol and the end token only; a null id counts as the empty text for the
fold, so it trains; without training documents every byte costs log10(1/256) and every token c = 0, N = 0, V = 0; repeated
rows train and are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escalade.llm.common import HashedWords, ready

MARK = 0xFF
_WORD, _GRAM = 0, 1
_END = b"\n"  # no word holds a line end
_PIECE = 1 << 20


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


class Trie:
    """The byte-context trie in memory: for the adaptive mode, and as the plain form of the model."""

    def __init__(self, order: int):
        self.order, self.next = order, {}

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.next.setdefault(context[len(context) - k:], Counter())[symbol] += 1

    def log10(self, context: bytes, symbol: int) -> float:
        excluded: set[int] = set()
        total = 0.0
        for k in range(self.order, -1, -1):
            seen = self.next.get(context[len(context) - k:], {})
            counts = {s: c for s, c in seen.items() if s not in excluded}
            if not counts:
                continue
            n, d = sum(counts.values()), len(counts)
            if symbol in counts:
                return total + np.log10(counts[symbol] / (n + d))
            total += np.log10(d / (n + d))
            excluded.update(counts)
        return total - np.log10(256 - len(excluded))

    def walk(self, text: bytes, learn: bool) -> float:
        """The code length of a text in log10, learning along the way or not."""
        data, score = bytes([MARK]) * self.order + text + bytes([MARK]), 0.0
        for i in range(self.order, len(data)):
            context = data[i - self.order:i]
            score += self.log10(context, data[i])
            if learn:
                self.learn(context, data[i])
        return score


class Lookup:
    """key (64 bits) -> value, in an open hash table of numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 1.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = np.isnan(self.values[at])
            spots, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[spots], self.values[spots] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; NaN where a key isn't in the table."""
        at = self._home(keys)
        out = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & ~np.isnan(out))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.values[at[open_]]
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & ~np.isnan(out[open_])]
        return out


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The (order + 1)-grams of a run of bytes, as big-endian numbers."""
    n = len(data) - order
    code = np.zeros(max(0, n), np.uint64)
    for i in range(order + 1):
        code = (code << np.uint64(8)) | data[i:i + n]
    return code


def _gram_run(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts in order, and how many each text has. Between texts the grams would mix; those go."""
    pad = bytes([MARK]) * order
    run = np.frombuffer(b"".join([pad + t + bytes([MARK]) for t in texts]), np.uint8)
    code = grams(run, order)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + order)])
    keep = np.ones(len(code), bool)
    for i in range(order):  # the places whose gram begins in one text and ends in the next
        cut = starts[1:] - order + i
        keep[cut] = False
    return code[keep], sizes


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``_PIECE`` bytes, each with the number of its first text."""
    first, run, held = 0, [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= _PIECE:
            yield first, run
            first, run, held = first + len(run), [], 0
    if run:
        yield first, run


def _statistics(order: int):
    """(kind, key, n): word counts of training texts, gram counts of training texts, and 0 for grams of others."""
    def rows(kind: int, key, n) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.full(len(key), kind, np.int32), "key": np.asarray(key, np.uint64).view(np.int64),
                             "n": np.asarray(n, np.int64)})

    def merged(parts):
        key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return key, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(key)).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        parts: list = []
        for pdf in batches:
            held = pdf["held"].to_numpy()
            for train in (True, False):
                for _, texts in _pieces(lowered(t) for t, h in zip(pdf["text"], held) if h != train):
                    key, n = np.unique(_gram_run(texts, order)[0], return_counts=True)
                    parts.append((key, n if train else np.zeros(len(key), np.int64)))
                    if sum(len(p[0]) for p in parts) > 3_000_000:
                        parts = [merged(parts)]
                    if len(parts) == 1 and len(parts[0][0]) > 2_000_000:
                        yield rows(_GRAM, *parts.pop())
                    if train:
                        for t in texts:
                            words.update(t.split())
                        words[_END] += len(texts)
                    if len(words) > 500_000:
                        yield rows(_WORD, [xxhash.xxh3_64_intdigest(w) for w in words], list(words.values()))
                        words.clear()
        if words:
            yield rows(_WORD, [xxhash.xxh3_64_intdigest(w) for w in words], list(words.values()))
        if parts:
            yield rows(_GRAM, *merged(parts))
    return run


def gram_costs(code: np.ndarray, n: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte after its context. ``code``/``n``: all grams whose contexts end in the
    same two bytes as any of these; ``pairs[a, b]``: how often b followed a in the training texts."""
    u = np.uint64
    levels = []  # from order ``order`` down to 2: (gram number, context number, n by gram, suffix gram number)
    code_k, n_k, up = code, n, None
    lowest = min(order, 2)
    for k in range(order, lowest - 1, -1):
        if k < order:
            code_k, up = np.unique(levels[-1][0] & u((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n_k = np.bincount(up, weights=levels[-1][2], minlength=len(code_k)).astype(np.int64)
        _, ctx = np.unique(code_k >> u(8), return_inverse=True)
        levels.append([code_k, ctx, n_k, up])
    # orders below: every (byte pair) of the table, then every byte
    if order >= 1:
        pair_code = np.arange(1 << 16, dtype=np.uint64)
        if lowest == 1:
            levels.pop()
        low = [[pair_code, (pair_code >> u(8)).astype(np.int64), pairs.reshape(-1).astype(np.int64), None]]
    else:
        levels, low = [], []
    single = pairs.sum(0).astype(np.int64)
    low.append([np.arange(256, dtype=np.uint64), np.zeros(256, np.int64), single, None])
    chain = levels + low
    for i in range(1, len(chain)):
        if chain[i][3] is None:  # where the longer grams' suffixes stand in a full table
            chain[i][3] = (chain[i - 1][0] & u(len(chain[i][0]) - 1)).astype(np.int64)
    place = np.arange(len(code)) if levels else ((code & u(len(chain[0][0]) - 1)).astype(np.int64))
    log, done = np.zeros(len(code)), np.zeros(len(code), bool)
    last_seen = None
    for i, (codes, ctx, counts, up) in enumerate(chain):
        if i:
            place = up[place]
        size = int(ctx.max()) + 1 if len(ctx) else 0
        total = np.bincount(ctx, weights=counts, minlength=size)
        kinds = np.bincount(ctx, weights=counts > 0, minlength=size)
        t, d = total[ctx[place]], kinds[ctx[place]]
        if i:  # leave out what the longer context has seen
            prev_codes, prev_ctx, prev_counts, _ = chain[i - 1]
            seen = prev_counts > 0
            out_n = np.bincount(prev_ctx[seen], weights=counts[up[seen]], minlength=last_seen[1])
            out_d = np.bincount(prev_ctx[seen], minlength=last_seen[1])
            t, d = t - out_n[prev_ctx[last_seen[0]]], d - out_d[prev_ctx[last_seen[0]]]
        here = counts[place]
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ~done & (here > 0)
            log = np.where(hit, log + np.log10(here / (t + d)), log)
            miss = ~done & ~hit & (d > 0)
            log = np.where(miss, log + np.log10(d / (t + d)), log)
        done |= hit
        last_seen = (place, size)
    unseen = 256 - int((single > 0).sum())
    return np.where(done, log, log - (np.log10(unseen) if unseen else 0.0))


def _costs(order: int, held_pairs):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(pdf["key"].to_numpy().view(np.uint64), pdf["n"].to_numpy()) for pdf in batches]
        if not parts:
            return
        code, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        at = np.argsort(code, kind="stable")
        code, n = code[at], n[at]
        for lo in range(0, len(code), 1 << 19) if order < 2 else [0]:
            hi = lo + (1 << 19) if order < 2 else len(code)
            yield pd.DataFrame({"key": code[lo:hi].view(np.int64), "value": gram_costs(code[lo:hi], n[lo:hi], order, held_pairs.value)})
    return run


def _split_table(table: DataFrame, weight: str, max_rows: int) -> tuple[pd.DataFrame, DataFrame | None]:
    """The rows of largest ``weight``, at most ``max_rows``, collected; the rest, or None if that was all."""
    steps = [0, *(1 << i for i in range(50))]
    n = table.agg(*[F.count(F.when(F.col(weight) >= s, 1)).alias(f"s{s}") for s in steps]).first()
    bound = next((s for s, c in zip(steps, n) if c <= max_rows), None)
    hot = table.filter(F.col(weight) >= bound) if bound is not None else table.limit(0)
    rest = None if bound == 0 else table if bound is None else table.filter(F.col(weight) < bound)
    got = hot.select("key", "value").toArrow()
    return pd.DataFrame({"key": got["key"].to_numpy().view(np.uint64), "value": got["value"].to_numpy()}), rest


def _tokens(texts: list[bytes], hashed: HashedWords, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text's followed by the end token, and the number of tokens by text."""
    flat, sizes = [], []
    for t in texts:
        words = t.split()
        flat.extend(map(hashed.__getitem__, words))
        flat.append(end)
        sizes.append(len(words) + 1)
    return np.array(flat, dtype=np.uint64), np.array(sizes)


def _counted(n: int, owner: np.ndarray, key: np.ndarray) -> tuple[list, list]:
    """By owner: its distinct keys, and how often each occurs."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.empty(0, np.int64)
    cuts = np.searchsorted(owner[first], np.arange(1, n))
    return np.split(key[first].view(np.int64), cuts), np.split(np.diff(np.r_[first, len(key)]), cuts)


def _scores(order: int, held_tables):
    """Sums by the tables for each text, and beside them the keys that the tables don't hold, with their counts."""
    state: dict = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not state:
            words, grams_ = held_tables.value
            state["words"], state["grams"], state["hash"] = Lookup(*words), Lookup(*grams_), HashedWords()
        end, unknown = xxhash.xxh3_64_intdigest(_END), np.log10(0.5)
        for pdf in batches:
            for first, texts in _pieces(lowered(t) for t in pdf["text"]):  # small pieces in, small pieces out
                n, own = len(texts), pdf.iloc[first:first + len(texts)]
                key, sizes = _tokens(texts, state["hash"], end)
                value, owner = state["words"].get(key), np.repeat(np.arange(n), sizes)
                gone = np.isnan(value)
                out = {"row": own["row"].to_numpy(), "doc_id": own["doc_id"].array, "held_out": own["held"].to_numpy(), "n_tokens": sizes,
                       "n_known": np.bincount(owner[~gone], minlength=n),
                       "base": np.bincount(owner, weights=np.where(gone, unknown, value), minlength=n)}
                words = _counted(n, owner[gone], key[gone])
                code, sizes = _gram_run(texts, order)
                cost, owner = state["grams"].get(code), np.repeat(np.arange(n, dtype=np.int32), sizes)
                lost = np.isnan(cost)
                lists = (*words, *_counted(n, owner[lost], code[lost]))
                cost[lost] = 0.0
                out["score"] = np.bincount(owner, weights=cost, minlength=n)
                named = zip(("words", "word_tf", "grams", "gram_tf"), lists)
                yield pd.DataFrame(out | {name: pd.Series(x, dtype=object) for name, x in named})
    return run


def score(docs: DataFrame, order: int = 4, folds: int = 5, held_fold: int = 1, mode: str = "pretrained",
          id_col: str = "doc_id", text_col: str = "text", max_words: int = 1_000_000, max_grams: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row.

    Rows whose crc32(id as text) mod ``folds`` is ``held_fold`` are scored but not learned from."""
    spark = ready(docs.sparkSession)
    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(id_col).cast("bigint").cast("string").alias("doc_id"),  # pandas would round bigints beside nulls
                       F.col(text_col).alias("text"), (F.crc32(text_id) % folds == held_fold).alias("held"))
    counted = (rows.select("text", "held").mapInPandas(_statistics(order), "kind int, key bigint, n bigint")
               .groupBy("kind", "key").agg(F.sum("n").alias("n")).checkpoint())
    words = counted.filter((F.col("kind") == _WORD) & (F.col("n") > 0)).select("key", "n")
    train_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    grams_ = counted.filter(F.col("kind") == _GRAM).select("key", "n")
    # orders 1 and 0: how often each byte followed each byte, 65,536 rows at most
    pairs = np.zeros((256, 256), np.int64)
    mask = (1 << 16) - 1 if order else 255
    for pair, n in grams_.filter("n > 0").groupBy(F.col("key").bitwiseAND(mask).alias("pair")).agg(F.sum("n")).collect():
        pairs[pair >> 8, pair & 255] = n
    held_pairs = spark.sparkContext.broadcast(pairs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), grams_.count() // 250_000)
    suffix = F.shiftright("key", 8).bitwiseAND((1 << 16) - 1)
    costs = (grams_.withColumn("suffix", suffix).repartition(parts, "suffix").select("key", "n")
             .mapInPandas(_costs(order, held_pairs), "key bigint, value double"))
    costs = costs.join(grams_.withColumnRenamed("n", "weight"), "key").checkpoint()
    valued = words.select("key", F.log10(F.col("n") + 0.5).alias("value"), F.col("n").alias("weight"))
    hot_words, rest_words = _split_table(valued, "weight", max_words)
    hot_grams, rest_grams = _split_table(costs, "weight", max_grams)
    tables = spark.sparkContext.broadcast([(t["key"].to_numpy(), t["value"].to_numpy()) for t in (hot_words, hot_grams)])
    whole = float(np.log10(train_tokens + 0.5 * (distinct + 1)))
    out = rows.mapInPandas(_scores(order, tables), "row bigint, doc_id string, held_out boolean, n_tokens bigint, n_known bigint, "
                                                   "base double, score double, words array<bigint>, word_tf array<bigint>, "
                                                   "grams array<bigint>, gram_tf array<bigint>")
    if rest_words is not None or rest_grams is not None:
        out = out.checkpoint()  # one pass over the texts for the sums and for what the tables don't hold
        empty = spark.createDataFrame([], "key bigint, value double")
        rest = ((rest_words or empty).select(F.lit(_WORD).alias("kind"), "key", (F.col("value") - F.log10(F.lit(0.5))).alias("value"))
                .unionByName((rest_grams or empty).select(F.lit(_GRAM).alias("kind"), "key", "value")))
        each = lambda kind, name: out.select("row", F.lit(kind).alias("kind"), F.inline(F.arrays_zip(
            F.col(f"{name}s").alias("key"), F.col(f"{name}_tf").alias("tf"))).alias("key", "tf"))
        beyond = each(_WORD, "word").unionByName(each(_GRAM, "gram")).join(rest, ["kind", "key"])
        on_word = F.col("kind") == _WORD
        more = beyond.groupBy("row").agg(
            F.sum(F.when(on_word, F.col("tf")).otherwise(0)).alias("more_known"),
            F.sum(F.when(on_word, F.col("tf") * F.col("value")).otherwise(0.0)).alias("more_base"),
            F.sum(F.when(on_word, 0.0).otherwise(F.col("tf") * F.col("value"))).alias("more_score"))
        out = out.drop("words", "word_tf", "grams", "gram_tf").join(more, "row", "left")
        out = out.fillna(0, ["more_known", "more_base", "more_score"]).withColumns({
            "n_known": F.col("n_known") + F.col("more_known"), "base": F.col("base") + F.col("more_base"),
            "score": F.col("score") + F.col("more_score")})
    if mode == "adaptive":
        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"row": pdf["row"], "alone": [Trie(order).walk(lowered(t), True) for t in pdf["text"]]})
        out = (out.drop("score").join(rows.mapInPandas(alone, "row bigint, alone double"), "row")
               .withColumnRenamed("alone", "score"))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(int(train_tokens)).cast("bigint").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")
