"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is the sequence of its words; two lines are near when one word inserted, deleted or replaced turns one into the
other (edit bound 1 over words). A line goes if an earlier line (by document id, then line number) equals it or is
near it; the earliest stays.

1. Every line with ``min_letters`` or more letters and digits gets a 128-bit key; equal lines are grouped, with their first place.
2. Two near lines agree on their first or on their second half (of the shorter line's length). Distinct lines that share
   no half with another line can't be near any, so only the others go on. This loses nothing and saves most variants.
3. Each of those emits its deletion neighbourhood as hashed keys: itself, and itself without word p, for every p whose word holds no
   number (lines that differ in a number say different things). A key
   is a sum of (word, place) hashes modulo 2^61 - 1, taken from prefix sums (in blocks of ``_BLOCK`` words, so that long
   lines don't cost the square of their length).
4. Equal keys meet. A line without its word p equals a whole line: near, one word apart. Two lines are equal without
   the same place p: near, one word replaced. (Two lines of one length that are near always meet at such a place.) Only
   the earliest line of each (key, place) is looked up, so a group of any size costs its rows, not its pairs.
5. The found earlier line is verified word by word (common prefix and suffix) on the texts.

Only keys are shuffled by line: every text is cut into words once for them, and once more only where a line is a candidate.
Texts meet candidate and removed line numbers by document: those small tables are broadcast if their counted size
allows, else joined by document id.

Defined cases: lines are cut at ``\\n``; lines with fewer than ``min_letters`` letters and digits (10) always stay: brackets, rules, list
marks and one-word lines recur in texts that have nothing to do with each other, and a text without them is broken. Near lines are
looked for from ``near_words`` words (5) on, as one word is all or much of what a shorter line says. Null texts stay null, texts without removed
lines stay as they are to the byte; a text may become empty or keep only short lines. Rows with one id and text are alike:
they keep or lose the same lines. Rows with one id but different texts are told apart by text. A null id counts as the
last. An empty table gives no rows. Columns of the input stay, but for ``n_lines``, ``n_removed`` and the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.llm.common import checked_broadcast, ready

_P = (1 << 61) - 1
_BLOCK = 32
_LAST = (1 << 63) - 1
MIN_LETTERS, NEAR_WORDS = 10, 5
LETTER, NUMBER = r"[\p{L}\p{N}]", r"\p{N}"


def enough_letters(line: Column, at_least: int) -> Column:
    """Whether a line holds so many letters and digits (other marks don't count); reads no further than that."""
    return line.rlike(rf"(?:[^\p{{L}}\p{{N}}]*{LETTER}){{{at_least}}}") if at_least > 0 else F.lit(True)


@dataclass(frozen=True)
class Places:
    """A line's place in the order of documents and lines, as one number: a bigint of the document's distance from the smallest
    id and the line, where both fit (aggregates of numbers stay in hash tables), else a decimal."""
    low: int
    shift: int
    wide: bool

    @staticmethod
    def of(docs: DataFrame) -> "Places":
        """For (doc, text): ids and text lengths tell what fits."""
        own = F.when(F.col("doc") < _LAST, F.col("doc"))
        low, high, size = docs.agg(F.min(own), F.max(own), F.max(F.octet_length("text"))).first()
        low, high, shift = low or 0, high or 0, (size or 0).bit_length() + 1
        return Places(low, shift, (high - low + 2) << shift >= _LAST)

    def at(self, doc: Column, line_no: Column) -> Column:
        if self.wide:
            return doc.cast("decimal(20,0)") * F.lit(1 << self.shift).cast("decimal(18,0)") + line_no
        # the null id, as the last, takes what no other id can take
        most = (_LAST >> self.shift) - 1
        return F.shiftleft(F.when(doc == _LAST, F.lit(most)).otherwise(doc - F.lit(self.low)), self.shift) + line_no

    def doc_and_line(self, at: Column) -> tuple[Column, Column]:
        if self.wide:
            line = (at % F.lit(1 << self.shift).cast("decimal(18,0)")).cast("bigint")
            return ((at - line) / F.lit(1 << self.shift).cast("decimal(18,0)")).cast("bigint"), line
        number, most = F.shiftright(at, self.shift), (_LAST >> self.shift) - 1
        doc = F.when(number == most, F.lit(_LAST)).otherwise(number + F.lit(self.low))
        return doc, at.bitwiseAND(F.lit((1 << self.shift) - 1))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda acc, x: (acc + x) % F.lit(_P))


def _blocks(xs: Column, n: Column) -> Column:
    starts = F.sequence(F.lit(0), F.floor((n - 1) / F.lit(_BLOCK)).cast("int"))
    return F.transform(starts, lambda b: F.slice(xs, b * _BLOCK + 1, _BLOCK))


def near_words_apart(a: Column, b: Column) -> Column:
    """Whether two word sequences are one word apart at most, which holds no number: what their common prefix and suffix leave over."""
    def agree(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), F.lit(False))
        return F.when(first > 0, first - 1).otherwise(F.greatest(F.size(x), F.size(y)))
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    ahead = agree(a, b)
    plain = lambda x: ~F.coalesce(F.get(x, ahead.cast("int")).rlike(NUMBER), F.lit(False))
    own = lambda x, y: (F.size(x) < F.size(y)) | plain(x)  # of different lengths only the longer one has a word of its own
    return (longer - shorter <= 1) & (ahead + agree(F.reverse(a), F.reverse(b)) >= longer - 1) & own(a, b) & own(b, a)


def lines_of(docs: DataFrame, places: Places) -> DataFrame:
    """(at, text_key, line) of every line of (doc, text), with spaces for the other blanks that part words."""
    text = F.col("text")
    spaced = F.when(text.rlike(r"[\t\x0B\f\r]"), F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)
    lines = docs.select("doc", F.xxhash64("text").alias("text_key"), F.posexplode(F.split(spaced, "\n", -1)).alias("line_no", "line"))
    return lines.select(places.at(F.col("doc"), F.col("line_no")).alias("at"), "text_key", "line")


def words_in(line: Column) -> Column:
    """The words of such a line (split at one character, for which no pattern has to be run)."""
    return F.array_remove(F.split(line, " ", -1), "")


def _half_keys(words: Column, n: Column) -> list[Column]:
    """Hashes of the first and last m words, for m = half of n and half of n - 1."""
    def key(side: int, m: Column) -> Column:
        part = F.slice(words, F.lit(1), m) if side == 0 else F.slice(words, n - m + 1, m)
        return F.xxhash64(F.lit(side), m, part)
    big, small = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return [key(0, big), key(1, big), key(0, small), key(1, small)]


def variants(lines: DataFrame) -> DataFrame:
    """(key, place, at, k1) of the deletion neighbourhoods of (at, k1, words); place 0 is the whole line."""
    salted = lambda shift: F.transform("words", lambda w, i: F.pmod(F.xxhash64(w, i - shift), F.lit(_P)))
    numbers = F.transform("words", lambda w, i: F.when(~w.rlike(NUMBER), i + 1))
    rows = lines.select("at", "k1", F.size("words").alias("n"), salted(0).alias("g"), salted(1).alias("h"),
                        F.array_compact(numbers).alias("cut"))
    rows = rows.select("at", "k1", "n", "cut", "g", "h", _sum(F.col("g")).alias("whole"), _sum(F.col("h")).alias("shifted"),
                       _blocks(F.col("g"), F.col("n")).alias("gb"), _blocks(F.col("h"), F.col("n")).alias("hb"))
    rows = rows.withColumn("gs", F.transform("gb", _sum)).withColumn("hs", F.transform("hb", _sum))
    before = lambda sums: F.transform(F.sequence(F.lit(1), F.size(sums)), lambda i: _sum(F.slice(sums, 1, i - 1)))
    rows = rows.withColumn("g0", before("gs")).withColumn("h0", before("hs"))

    def without(place: Column) -> Column:
        block, inside = F.floor((place - 1) / F.lit(_BLOCK)).cast("int") + 1, (place - 1) % _BLOCK
        ahead = F.element_at("g0", block) + _sum(F.slice(F.element_at("gb", block), 1, inside))
        through = F.element_at("h0", block) + _sum(F.slice(F.element_at("hb", block), 1, inside + 1))
        return F.pmod(ahead % _P + F.col("shifted") - through % _P, F.lit(_P))

    keys = F.concat(F.array(F.struct(F.col("whole").alias("key"), F.lit(0).alias("place"))),
                    F.transform("cut", lambda p: F.struct(without(p).alias("key"), p.alias("place"))))
    return rows.select("at", "k1", F.explode(keys).alias("v")).select("v.key", "v.place", "at", "k1")


def earliest_near(lines: DataFrame) -> DataFrame:
    """(at, k1, first): for (at, k1, words) of distinct lines, the place of the earliest near line where one is earlier,
    before verification."""
    v = variants(lines).repartition("key")
    by_place = v.groupBy("key", "place").agg(F.min("at").alias("m"), F.count(F.lit(1)).alias("c"))
    by_key = by_place.groupBy("key").agg(F.min(F.when(F.col("place") == 0, F.col("m"))).alias("whole"),
                                         F.min(F.when(F.col("place") > 0, F.col("m"))).alias("cut"),
                                         F.sum("c").alias("c")).filter("c > 1").drop("c")
    met = v.join(by_key, "key").join(by_place.drop("c"), ["key", "place"])
    found = F.when(F.col("place") == 0, F.col("cut")).otherwise(F.least("m", "whole"))
    return (met.select("at", "k1", found.alias("first")).filter(F.col("first") < F.col("at"))
            .groupBy("at", "k1").agg(F.min("first").alias("first")))


def repeated_lines(docs: DataFrame, min_letters: int = MIN_LETTERS, near_words: int = NEAR_WORDS, short_too: bool = False) -> DataFrame:
    """(doc, text_key, line_no) of the lines of (doc, text) to remove, and where the line that stays for each begins:
    (kept_doc, kept_line). A line may point to one that goes itself for an earlier one. With ``short_too`` also the non-blank lines
    under ``min_letters`` that equal an earlier line; ``long`` is false for them."""
    places = Places.of(docs)
    words, n = F.col("words"), F.size("words")
    long = enough_letters(F.col("line"), min_letters)
    keys = [F.when((n >= near_words) & F.col("long"), key).alias(f"half{i}") for i, key in enumerate(_half_keys(words, n))]
    # all that is needed of every line, in numbers: written once, read for the groups and for what goes
    lines = lines_of(docs, places).withColumn("long", long).filter(F.lit(short_too) | F.col("long"))
    lines = (lines.withColumn("words", words_in(F.col("line"))).filter(n > 0)
             .select("text_key", "at", "long", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), *keys)).checkpoint()
    halves = [f"half{i}" for i in range(4)]
    groups = lines.groupBy("k1", "k2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("c"),
                                           *[F.max(h).alias(h) for h in halves]).checkpoint()
    each = (groups.filter("half0 is not null").select("at", "k1", F.explode(F.array_distinct(F.array(*halves))).alias("half"))
            .repartition("half"))
    shared = each.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    chosen = each.join(shared, "half").select("at", "k1").distinct().checkpoint()
    texts = (lines_of(docs, places).join(checked_broadcast(chosen, 40), "at").withColumn("words", words_in(F.col("line")))
             .filter(F.xxhash64("words") == F.col("k1")).select("at", "k1", "words").dropDuplicates(["at", "k1"]).checkpoint())
    pairs = earliest_near(texts)
    ours, theirs = texts.withColumnRenamed("words", "a"), texts.select(F.col("at").alias("first"), F.col("words").alias("b"))
    near = (pairs.join(ours, ["at", "k1"]).join(theirs, "first").filter(near_words_apart(F.col("a"), F.col("b")))
            .select("at", "k1", F.col("first").alias("near")).distinct())
    gone = groups.select("k1", "k2", "at", "c").join(near, ["at", "k1"], "left").filter("c > 1 or near is not null")
    gone = gone.select("k1", "k2", F.col("at").alias("first_at"), "near")
    removed = (lines.select("text_key", "at", "long", "k1", "k2").join(gone, ["k1", "k2"])
               .filter((F.col("at") != F.col("first_at")) | F.col("near").isNotNull()))
    (doc, line), (kept_doc, kept_line) = places.doc_and_line(F.col("at")), places.doc_and_line(F.coalesce("near", "first_at"))
    return removed.select(doc.alias("doc"), "text_key", line.alias("line_no"), "long", kept_doc.alias("kept_doc"), kept_line.alias("kept_line"))


def dedup_lines(docs: DataFrame, min_letters: int = MIN_LETTERS, near_words: int = NEAR_WORDS, id_col: str = "doc_id",
                text_col: str = "text", count_names: tuple[str, ...] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and its numbers of lines (before) and of removed ones; with two more names
    also of its own lines (not blank, they stay and equal no earlier line) and of those that equal or nearly equal one (removed or, if short, not)."""
    ready(docs.sparkSession)
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    repeats = repeated_lines(docs.select(doc.alias("doc"), F.col(text_col).alias("text")), min_letters, near_words, len(count_names) > 2)
    by_doc = (repeats.groupBy("doc", "text_key").agg(F.collect_set(F.when(F.col("long"), F.col("line_no"))).alias("gone"),
                                                     F.count_distinct("line_no").alias("repeats"))
              .select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), F.col("gone").alias("_gone"),
                      F.col("repeats").alias("_repeats")).checkpoint())
    numbers = by_doc.agg(F.count(F.lit(1)), F.sum(F.size("_gone"))).first()
    if 56 * numbers[0] + 8 * (numbers[1] or 0) <= 32 << 20:
        by_doc = F.broadcast(by_doc)
    # the text goes on as its lines, split once: what is looked up by number below has to be there already
    plain = docs.drop(*count_names)
    held = plain.select(*[F.col(f"`{c}`") for c in plain.columns if c != text_col], doc.alias("_own"), F.xxhash64(F.col(text_col)).alias("_own_key"),
                        F.split(F.col(text_col), "\n", -1).alias("_lines"))
    joined = held.join(by_doc, (F.col("_own") == F.col("_doc")) & (F.col("_own_key") == F.col("_key")), "left")
    pieces = F.col("_lines")
    stay = F.array_except(F.sequence(F.lit(0).cast("bigint"), (F.size(pieces) - 1).cast("bigint")), F.col("_gone"))
    kept = F.when(F.coalesce(F.size("_gone"), F.lit(0)) == 0, pieces).otherwise(F.transform(stay, lambda i: F.get(pieces, i.cast("int"))))
    counts = [F.size(pieces), F.size("_gone")]
    if len(count_names) > 2:
        repeats = F.coalesce("_repeats", F.lit(0))
        counts += [F.size(F.filter(pieces, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))) - repeats, repeats]
    cols = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in plain.columns]
    return joined.select(*cols, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for c, name in zip(counts, count_names)])
