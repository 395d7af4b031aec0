"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, numbered, small, text_of, written
from tidewatch.session import drop_scratch

#: A line of this many words or more has deletion variants: one edit leaves a similarity of 0.8.
FIVE = 5
#: Buckets of words whose rough counts order the word pairs of a line.
BUCKETS = 1 << 16
#: Bits of the number of words of a line, and of a place in it, that go with a pair's hash, and the most they tell.
PLACE = 11
LONG = (1 << PLACE) - 1
#: Joins with texts are made in so many parts at most, one after another: a part's shuffle files go before the next begins.
PARTS = 8
#: So many rows of keys take as much room as a row of line numbers.
KEYS = 8


def _parts(n: int, most: int) -> int:
    """Parts of ``n`` rows: of fewer than ``most`` each, if that takes no more than ``PARTS``."""
    return 1 if n <= most else min(PARTS, math.ceil(1.25 * n / most))


def _of_part(df: DataFrame, key: str, part: int, parts: int) -> DataFrame:
    return df if parts == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def _written_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """All ``parts``, each written before the next is made."""
    return reduce(DataFrame.union, [written(part, name) for part in parts])


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _spelling(line: Column) -> Column:
    """The words of a line with one space between them. Most lines are spelled so already."""
    other = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in "\t\r\x0b\x0c":
        other = other | F.contains(line, F.lit(space))
    words = F.regexp_extract_all(line, F.lit(f"({WORD})"), F.lit(1))
    return F.when(other, F.array_join(words, " ")).otherwise(line)


def _half_keys(spelling: Column, n: Column) -> Column:
    """Keys of which two lines within one edit share at least one.

    One edit of a word leaves the first or the second half as it is: with n and n' words, n' = n
    or n - 1, they share the first or the last n' / 2 words (rounded down; n / 2 if n' = n).
    """
    keys = []
    for m in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        keys.append(F.xxhash64(F.lit("head"), m, F.call_function("substring_index", spelling, F.lit(" "), m)))
        keys.append(F.xxhash64(F.lit("tail"), m, F.call_function("substring_index", spelling, F.lit(" "), -m)))
    return F.array_distinct(F.array(*keys))


def _first(name: str = "first") -> Column:
    """Place of a line that orders occurrences: by doc_id (null last), then row, then line."""
    return F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "_row", "line").alias(name)


def line_table(docs: DataFrame, halves: bool = True) -> DataFrame:
    """Lines with words, of numbered rows: _row, doc_id, line (from 0), n (words), h1, h2 (digests), halves (keys, if wanted)."""
    text = docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    lines = text.select("_row", "doc_id", F.posexplode(_lines(F.col("text"))).alias("line", "content"))
    spelled = lines.select("_row", "doc_id", "line", _spelling(F.col("content")).alias("s")).filter("s <> ''")
    n = F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "), F.lit(""))) + 1
    spelled = spelled.withColumn("n", n)
    keys = [F.when(F.col("n") >= FIVE - 1, _half_keys(F.col("s"), F.col("n"))).alias("halves")] if halves else []
    return written(spelled.select(
        "_row", "doc_id", "line", "n", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("line"), "s", "n").alias("h2"), *keys), "lines")


def _candidates(docs: DataFrame, seen: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Classes that share a half with another: no (ascending with first), first, words."""
    halves = seen.filter("halves IS NOT NULL").select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi")
    # Copies of a line have one h1, and a task sends each (line, half) once.
    alike = written(halves.distinct().join(shared.select("half"), "half", "left_semi").select("h1").distinct(), "line-halves")
    return _words_of(docs, classes.join(alike, "h1", "left_semi"), most).select("no", "first", F.split("s", " ").alias("words"))


def _words_of(docs: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """The words of the first lines of classes, read again: no (ascending with first), first, s (the words, spaced).

    The numbers come from ranges of ``first``, sorted within, so their order is that of ``first``.
    """
    numbered = written(chosen.select("first").repartitionByRange("first").sortWithinPartitions("first").select(
        F.monotonically_increasing_id().alias("no"), "first"), "line-numbers")
    wanted = written(numbered.groupBy(F.col("first._row").alias("_row")).agg(
        F.collect_list(F.struct("no", "first")).alias("lines")), "line-wanted")
    text = docs.select("_row", text_of().alias("text"))
    parts = _parts(numbered.count(), most)

    def again(part: int) -> DataFrame:
        own = _of_part(wanted, "_row", part, parts)
        # A row holds all lines of its text, so the lines are counted and not the rows.
        few = own.agg(F.sum(F.size("lines"))).first()[0] or 0
        both = _of_part(text, "_row", part, parts).join(F.broadcast(own) if 0 < few <= most else own, "_row").select(
            _lines(F.col("text")).alias("all"), F.explode("lines").alias("one"))
        # A line takes less room than the list of its words.
        return both.select("one.no", "one.first", _spelling(F.element_at("all", F.col("one.first.line") + 1)).alias("s"))

    found = _written_parts(map(again, range(parts)), "line-candidates")
    drop_scratch(numbered, "line-numbers")
    drop_scratch(wanted, "line-wanted")
    return found


def near_classes(docs: DataFrame, seen: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Firsts of the classes that are one word edit from an earlier class.

    1. Half keys: a class that shares neither half with another can have no partner. Only
       classes that share one go on, and only their words are read again.
    2. Each emits its deletion variants as hashed keys: the line and the line without each word.
       Lines of one key are one edit apart if both lack the word at the same place (replaced) or
       one lacks none (inserted, dropped).
    3. Per key and place only the earliest is kept, never the pairs; each line is compared with
       the earliest of its keys, and the edit distance of that pair is verified on the words.
    """
    lines = _candidates(docs, seen, classes, most)

    # A variant's hash is the sum of its words' hashes, each taken with its place in the variant:
    # words before the deleted one stay in place, those behind it move up. So all variants of a
    # line follow from running sums, and a line of any length takes time in proportion. Terms
    # have 44 bits; half a million words fit. The window sees one line at a time.
    each = lines.select("no", "words").repartition("no").select(
        "no", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    each = each.select("no", "n", (F.col("i") + 1).alias("i"), *[
        F.shiftright(F.xxhash64(F.lit(s), "word", F.col("i") + shift), 20).alias(f"{side}{s}")
        for s in (1, 2) for side, shift in (("stay", 1), ("move", 0))])
    so_far = Window.partitionBy("no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("no")
    sums = each
    for s in (1, 2):
        sums = sums.withColumns({f"all{s}": F.sum(f"stay{s}").over(so_far), f"tail{s}": F.sum(
            f"move{s}").over(line) - F.sum(f"move{s}").over(so_far)})
    without = F.xxhash64(F.col("n") - 1, *[F.col(f"all{s}") - F.col(f"stay{s}") + F.col(f"tail{s}") for s in (1, 2)])
    whole = F.xxhash64("n", "all1", "all2")
    # The line itself comes with its last word.
    place = F.struct(F.lit(0).alias("i"), whole.alias("key"))
    variants = written(sums.select("no", F.explode(F.filter(F.array(
        F.when(F.col("n") >= FIVE, F.struct("i", without.alias("key"))),
        F.when(F.col("i") == F.col("n"), place)), lambda v: v.isNotNull())).alias("v")).select("no", "v.i", "v.key"), "line-variants")

    of_key = variants.groupBy("key").agg(
        F.count("*").alias("rows"), F.min(F.struct("no", "i")).alias("any"),
        F.min(F.when(F.col("i") == 0, F.col("no"))).alias("whole")).filter("rows > 1").drop("rows")
    met = written(variants.join(of_key, "key"), "line-met")
    same = met.groupBy("key", "i").agg(F.min("no").alias("same"))
    replaced = F.struct(F.col("same").alias("no"), F.col("i"))
    inserted = F.struct(F.col("whole").alias("no"), F.lit(0).alias("i"))
    best = F.when(F.col("i") == 0, F.col("any")).when(
        F.col("whole").isNull() | (F.col("same") <= F.col("whole")), replaced).otherwise(inserted)
    pairs = met.join(same, ["key", "i"]).select("no", "i", best.alias("best")).filter(
        F.col("best.no") < F.col("no")).groupBy("no").agg(F.min(F.struct("best", "i")).alias("p")).select(
        "no", F.col("p.i").alias("place"), F.col("p.best.no").alias("partner"), F.col("p.best.i").alias("other"))

    def dropped(words: str, place: str) -> Column:
        """The words without the one at ``place``; all of them at place 0."""
        w, at = F.col(words), F.col(place)
        return F.when(at == 0, w).otherwise(F.concat(
            F.slice(w, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(w, at + 1, F.size(w))))

    own = lines.select("no", "first", F.col("words").alias("w")).join(pairs, "no")
    both = own.join(lines.select(F.col("no").alias("partner"), F.col("words").alias("v")), "partner")
    return both.filter(dropped("w", "place") == dropped("v", "other")).select("first")


def _rarity(docs: DataFrame) -> str:
    """A character per bucket of words, larger the more often they come in an eighth of the texts.

    It only orders word pairs so that few lines meet in one; the lines found are the same by any order.
    """
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(8)) == 0)
    words = some.select(F.explode(F.split(text_of(), "[ \n\t\r\x0b\x0c]+")).alias("word"))
    counts = dict(words.groupBy(_bucket(F.col("word")).alias("b")).count().collect())
    return "".join(chr(33 + min(93, int(3 * math.log2(1 + counts.get(b, 0))))) for b in range(BUCKETS))


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, not again for each element of an array within."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rare_pairs(words: Column, n: Column, per_edit: int, rarity: str) -> Column:
    """The rarest pairs of neighbouring words, of which lines within the bound share two: key, i (place).

    With d = n / per_edit edits at most (n words in the longer line), at most 2 d of its n - 1 pairs are
    lost, so of its 2 d + 2 first pairs by any order, and of as many of the shorter less the words it
    lacks, two are common to both, no more than d places apart. A line is the longer or the shorter one;
    the shorter needs one more if one word more allows one more edit.
    """
    table = F.lit(bytearray(rarity, "ascii"))

    def grade(w: Column) -> Column:
        return F.ascii(F.call_function("substring", table, _bucket(w) + 1, F.lit(1)).cast("string")).cast("long")

    def pair(a: Column, b: Column, i: Column) -> Column:
        grades = F.shiftleft(F.least(a["g"], b["g"]), 56).bitwiseOR(F.shiftleft(F.greatest(a["g"], b["g"]), 49))
        return F.struct(grades.bitwiseOR(F.shiftrightunsigned(F.xxhash64(a["w"], b["w"]), 15)).alias("key"), i.alias("i"))

    longer, shorter = 2 * F.floor(n / per_edit) + 2, 2 * F.floor((n + 1) / per_edit) + 1
    graded = F.transform(words, lambda w: F.struct(w.alias("w"), grade(w).alias("g")))
    every = _once(graded, lambda g: F.transform(F.sequence(F.lit(1), n - 1), lambda i: pair(F.get(g, i - 1), F.get(g, i), i)))
    return F.slice(F.sort_array(every), F.lit(1), F.greatest(longer, shorter).cast("int"))


def _within(n: Column, m: Column, per_edit: int) -> Column:
    """Edits allowed between lines of n and m words."""
    return F.floor(F.greatest(n, m) / per_edit).cast("int")


def word_edits(words: Column, others: Column, most: Column) -> Column:
    """Word edit distance, -1 if above ``most``: each word becomes one character, numbered within the two lines."""
    def spelled(line: Column, known: Column) -> Column:
        codes = F.transform(line, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0x10000), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    return _once(F.array_distinct(F.concat(words, others)), lambda known: F.call_function(
        "levenshtein", spelled(words, known), spelled(others, known), most))


def similar_classes(docs: DataFrame, classes: DataFrame, most: int, per_edit: int) -> DataFrame:
    """Firsts of the classes within one word edit for every ``per_edit`` words of an earlier class.

    1. Each class sends its rarest word pairs as keys (``_rare_pairs``); classes within the bound share two.
    2. Each is compared with the earliest of its keys. That settles families of like lines
       without their pairs.
    3. Those left are compared with all earlier ones that share two keys and whose length and places fit.
    """
    read = _words_of(docs, classes, most)
    n = F.size("words")
    pairs = _rare_pairs(F.col("words"), n, per_edit, _rarity(docs))
    # Not explode: it adds a filter that works the pairs out a second time. No line here is without.
    # Two numbers a row are shuffled: the pair's hash has n and place behind it, each up to LONG.
    at = F.shiftleft(F.least("n", F.lit(LONG)).cast("long"), PLACE).bitwiseOR(F.least("p.i", F.lit(LONG)).cast("long"))
    sent = read.select("no", F.split("s", " ").alias("words")).select("no", n.alias("n"), F.explode_outer(pairs).alias("p")).select(
        F.shiftleft("p.key", 2 * PLACE).bitwiseOR(at).alias("sent"), "no").repartition(F.shiftrightunsigned("sent", 2 * PLACE))
    keys = sent.select(F.shiftrightunsigned("sent", 2 * PLACE).alias("key"), "no", F.col("sent").bitwiseAND((1 << 2 * PLACE) - 1).alias("at"))
    of_key = Window.partitionBy("key")
    met = keys.withColumns({"lo": F.first(F.struct("no", "at")).over(of_key.orderBy("no")), "hi": F.max("no").over(of_key)})
    met = written(met.filter(F.col("lo.no") < F.col("hi")).drop("hi"), "line-met")

    def fits(a: str, b: str) -> Column:
        (n, i), (m, j) = [(F.shiftright(x, PLACE), F.col(x).bitwiseAND(LONG)) for x in (a, b)]
        bound = _within(n, m, per_edit)
        # Of a line that long, n and place are not known: its words decide.
        return (F.greatest(n, m) == LONG) | (F.abs(n - m) <= bound) & (F.abs(i - j) <= bound)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The later line of each pair within the bound: no, first (once for each part that finds it).

        The words of the later lines are written with their pairs, then they meet those of the earlier ones.
        """
        rows = pairs.count()
        parts = _parts(rows, most)

        def few(chosen: DataFrame) -> DataFrame:
            return F.broadcast(chosen) if rows <= most * parts else chosen

        def later(part: int) -> DataFrame:
            return _of_part(read, "no", part, parts).join(few(_of_part(pairs, "no", part, parts)), "no").select("no", "other", "first", "s")

        own = _written_parts(map(later, range(parts)), f"{name}-words")

        def near(part: int) -> DataFrame:
            mine = _of_part(own, "other", part, parts)
            asked = _of_part(pairs.select("other"), "other", part, parts).distinct()
            theirs = _of_part(read.select(F.col("no").alias("other"), F.col("s").alias("t")), "other", part, parts).join(
                few(asked), "other", "left_semi")
            w, v = F.split("s", " "), F.split("t", " ")
            bound = _within(F.size(w), F.size(v), per_edit)
            # A word that the other line lacks takes an edit: that settles most pairs at little cost.
            lacked = F.greatest(F.size(F.array_except(w, v)), F.size(F.array_except(v, w)))
            return mine.join(theirs, "other").filter(F.when(lacked <= bound, word_edits(w, v, bound) >= 0)).select("no", "first").distinct()

        found = _written_parts(map(near, range(parts)), name)
        drop_scratch(own, f"{name}-words")
        return found

    tried = written(met.filter(F.col("lo.no") < F.col("no")).filter(fits("at", "lo.at")).select(
        "no", F.col("lo.no").alias("other")).distinct(), "line-pairs")
    one = verified(tried, "line-near")
    parts = _parts(met.count(), KEYS * most)

    def meetings(part: int) -> DataFrame:
        here = _of_part(met.select("key", "no", "at"), "key", part, parts)
        left = here.join(one.select("no").distinct(), "no", "left_anti")
        others = here.select("key", F.col("no").alias("other"), F.col("at").alias("there"))
        return left.join(others, "key").filter(F.col("other") < F.col("no")).filter(fits("at", "there")).select("no", "other")

    shared = _written_parts(map(meetings, range(parts)), "line-shared")
    drop_scratch(met, "line-met")
    rest = shared.groupBy("no", "other").count().filter("count > 1").join(tried, ["no", "other"], "left_anti").select("no", "other")
    rest = written(rest, "line-pairs-rest")
    drop_scratch(shared, "line-shared")
    out = written(one.union(verified(rest, "line-near-rest")).select("first").distinct(), "line-similar")
    drop_scratch(read, "line-candidates")
    return out


def line_marks(docs: DataFrame, most: int, per_edit: int | None = None) -> DataFrame:
    """Lines to drop, by row: _row, _gone (line numbers), _near (how many only resemble a line)."""
    seen = line_table(docs, halves=per_edit is None)
    classes = written(seen.groupBy("h1", "h2", "n").agg(F.min(_first()).alias("first"), F.count("*").alias("copies")), "line-classes")
    able = classes.filter(F.col("n") >= FIVE - 1)
    near = near_classes(docs, seen, able, most) if per_edit is None else similar_classes(docs, able, most, per_edit)
    near = near.withColumn("near", F.lit(True))
    judged = classes.join(near, "first", "left").select(
        "h1", "h2", "n", "copies", "first", F.coalesce("near", F.lit(False)).alias("near")).filter("near OR copies > 1")
    marked = seen.select("_row", "line", "h1", "h2", "n").join(judged, ["h1", "h2", "n"])
    own = (F.col("first._row") == F.col("_row")) & (F.col("first.line") == F.col("line"))
    return written(marked.filter(F.col("near") | ~own).groupBy("_row").agg(
        F.collect_list("line").alias("_gone"), F.count(F.when(own, 1)).alias("_near")), "line-marks")


def dedup_lines(docs: DataFrame, keep: list[str] | None = None, most: int = 500_000, per_edit: int | None = None) -> DataFrame:
    """Documents without the lines that repeat an earlier one.

    Lines (split at line feeds) are sequences of words, runs of other than ASCII white space. A
    line is dropped if an earlier line anywhere, by doc_id, then row, then place, has the same
    words, or is one word edit (a word replaced, inserted or dropped) away and the longer of the
    two has five words or more: a similarity of 0.8 or more. With ``per_edit`` (5 or more) the bound
    grows with the line: one edit for every ``per_edit`` words of the longer line, so 5 stands for
    a similarity of 0.8 at every length. Earlier lines count whether or not
    they are dropped themselves. Lines without words always stay.

    Returns the columns ``keep`` (doc_id) of every row, text (the lines left, joined by line feeds; null stays null), and in
    a struct ``lines`` all (lines; a null text is one empty line), dropped, near (dropped with no equal line before) and words
    (whether a line with words is left). Null doc_ids come last; rows with
    equal ids or texts are rows of their own, in the order of the scan. Empty table: no rows.
    Tables of line numbers by row are broadcast if they have at most ``most`` rows (some 50 MB);
    beyond that the texts are shuffled to them.
    """
    keep = ["doc_id"] if keep is None else [c for c in keep if c != "text"]
    if "lines" in keep:
        raise ValueError("the column lines would be overwritten")
    if per_edit is not None and per_edit < FIVE:
        raise ValueError("per_edit must be 5 or more")
    # What is kept goes along as one column, so its names meet none of those here.
    kept = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`").alias(f"{i + 1}") for i, c in enumerate(keep)])
    text = numbered(docs.select(kept.alias("_kept"), "doc_id", "text"))
    marks = small(line_marks(text.drop("_kept"), most, per_edit), most)
    every = _lines(text_of())
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    parted = text.join(marks, "_row", "left").withColumn("_every", every).withColumn("_gone", gone)
    number = F.size("_every")
    stay = F.array_except(F.sequence(F.lit(0), number - 1), F.col("_gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("_every"), i + 1)), "\n")
    left = F.when(F.size("_gone") == 0, F.col("text")).otherwise(rest)
    back = [F.col("_kept")[f"{i + 1}"].alias(c) for i, c in enumerate(keep)]
    return parted.withColumn("_left", left).select(*back, F.col("_left").alias("text"), F.struct(
        number.cast("long").alias("all"), F.size("_gone").cast("long").alias("dropped"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("near"),
        F.coalesce(F.col("_left").rlike(WORD), F.lit(False)).alias("words")).alias("lines"))
