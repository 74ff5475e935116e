"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers, and names become typed placeholders, so that a
question with other numbers or names still shares its template with the
benchmark item. Windows of canonical words are hash-joined, hits are gathered
by item and offset, and a window counts only when its slots are consistent:
each value of the item always stands for the same value of the document. With
by_window, windows of the words as they are written are joined beside them,
from the same scan: those hold the item's own values, whatever their slots. A
document is contaminated by an item when consistent windows, or windows as
written, cover MIN_COVERED of its words, or the whole item where it is shorter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, table, text_of, words_of

WINDOW, MIN_COVERED = 8, 13
#: Plain words that a window of canonical words needs besides placeholders; with fewer, only the words as written count.
MIN_PLAIN = 5
#: Item windows that are broadcast at once: about 40 MB; more are handled in as many passes as it takes.
BROADCAST_WINDOWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NUMBER = r"\d+(?:[.,]\d+)*"
#: Words that open sentences and are no names.
OPENERS = (
    "A An The This That These Those There Here It Its He She They We You I His Her Their Our Your My If When While Where Which Who Whom Whose What Why How "
    "In On At By For From To Of With Without After Before During Since Until As And But Or Nor So Yet Then Now Not No Yes All Any Each Every Some Many Most Much Few Several "
    "One Two Three Is Are Was Were Do Does Did Has Have Had Can Could May Might Must Shall Should Will Would Let Given Find Suppose Assume Calculate Compute Determine Choose Consider"
).split()
_PLAIN = rf"(?!(?:{'|'.join(OPENERS)})(?![\p{{L}}\p{{N}}]))"
#: A run of capitalised words that open no sentence by themselves; the look-ahead comes first, as it fails fastest.
NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_PLAIN}\p{{Lu}}\p{{Ll}}+(?: {_PLAIN}\p{{Lu}}\p{{Ll}}+){{0,4}}(?![\p{{L}}\p{{N}}])"
#: Units of measure and currency, as whole words after a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs ms day days week weeks month months year years second seconds minute minutes hour hours "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres "
    "percent dollar dollars cent cents euro euros usd eur gbp degree degrees w kw v a hz khz mhz ghz kb mb gb tb mph kmh"
).split()
#: Placeholders start with a private-use character, so that no text spells one and the number pattern passes them by.
NUM, UNIT, NAME_SLOT = "\ue000num", "\ue000unit", "\ue000name"
UNIT_PATTERN = rf"(?i)(?<={NUM} )\s{{0,4}}(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"


def canonical(df: DataFrame, text, *keep: str) -> DataFrame:
    """keep, _w (canonical words) and _t1, _t2 (text after names and after numbers), from which slot values are read."""
    one = df.select(*keep, text.alias("_t0")).withColumn("_t1", F.regexp_replace("_t0", NAME, f" {NAME_SLOT} "))
    two = one.withColumn("_t2", F.regexp_replace("_t1", NUMBER, f" {NUM} "))
    three = two.withColumn("_t3", F.regexp_replace("_t2", UNIT_PATTERN, f"{UNIT} "))
    return three.select(*keep, "_t0", "_t1", "_t2", words_of(F.lower("_t3"), SEPARATORS).alias("_w"))


def word_hashes(words: str):
    """A 64-bit hash of each word, from which all windows that hold it are hashed."""
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: str, written: bool = False) -> str:
    """Hashes of all windows of an array of word hashes, of another family for words as written."""
    cols = ", ".join(f"{hashes}[i + {j}]" for j in range(WINDOW)) + ", 1" * written
    return f"case when size({hashes}) >= {WINDOW} then transform(sequence(0, size({hashes}) - {WINDOW}), i -> xxhash64({cols})) else cast(array() as array<bigint>) end"


def slots(cut: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, kind, value) of every placeholder: the n-th placeholder of a kind holds the n-th match of its pattern."""
    at = lambda slot: F.expr(f"filter(sequence(0, size(_w) - 1), i -> _w[i] = '{slot}')")
    kinds = (
        (NAME_SLOT, F.regexp_extract_all("_t0", F.lit(f"({NAME})"))),
        (NUM, F.regexp_extract_all("_t1", F.lit(f"({NUMBER})"))),
        (UNIT, F.regexp_extract_all("_t2", F.lit(f"({UNIT_PATTERN})"))),
    )
    full = cut.filter(F.size("_w") > 0)
    out = None
    for kind, values in kinds:
        pairs = F.arrays_zip(at(kind).alias("pos"), values.alias("value"))
        part = full.select(*keep, F.explode(pairs).alias("z")).select(*keep, F.col("z.pos").alias("pos"), F.lit(kind).alias("kind"), F.lower(F.trim("z.value")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.filter("pos is not null and value is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", by_window: bool = False) -> DataFrame:
    """(id, item, covered, item_words, first_word, last_word, n_slots, text_hash) for every document and item whose template it holds.

    An item with fewer words than WINDOW never matches. Null and empty texts
    match nothing; rows that share an id and a text count once, and a null id is
    an id of its own. Items with equal text each give a row. Other columns are
    not read; an empty side gives an empty result. by_window judges slots window
    by window, so that a slot altered on its own costs no more than the windows
    that hold both, and counts windows as written; else it costs every window of
    its offset. covered, item_words, first_word and last_word count canonical
    words, or words as written where those cover more.
    """
    items = benchmark.select(F.col(item_col).alias("_item"), text_of(benchmark, item_text_col).alias("_it"))
    item_cut = materialize(canonical(items, F.col("_it"), "_item"), "items")
    hashed = item_cut.withColumn("_x", word_hashes("_w"))
    exploded = hashed.select("_item", F.size("_w").alias("item_words"), "_w", F.posexplode(F.expr(window_hashes("_x"))).alias("ipos", "h"))
    plain = F.size(F.filter(F.slice("_w", F.col("ipos") + 1, WINDOW), lambda x: ~x.isin(NUM, UNIT, NAME_SLOT)))
    item_windows = exploded.filter(plain >= MIN_PLAIN).select("_item", "item_words", "ipos", "h", F.lit(False).alias("written"))
    if by_window:
        raw = item_cut.select("_item", word_hashes(words_of(F.lower("_t0"), SEPARATORS)).alias("_r"))
        raw = raw.select("_item", F.size("_r").alias("item_words"), F.posexplode(F.expr(window_hashes("_r", True))).alias("ipos", "h"))
        item_windows = item_windows.unionByName(raw.withColumn("written", F.lit(True)))
    item_windows = materialize(item_windows, "windows")
    passes = max(1, -(-item_windows.count() // BROADCAST_WINDOWS))

    source = docs.select(F.col(id_col).alias("_id"), text_of(docs, text_col).alias("_dt"))
    cut = canonical(source.withColumn("_th", F.xxhash64("_dt")), F.col("_dt"), "_id", "_th").withColumn("_x", word_hashes("_w")).withColumn("_hc", F.expr(window_hashes("_x")))
    every = F.col("_hc")
    if by_window:
        cut = cut.withColumn("_r", word_hashes(words_of(F.lower("_t0"), SEPARATORS)))
        every = F.concat("_hc", F.expr(window_hashes("_r", True)))
    windows = cut.select("_id", "_th", F.size("_hc").alias("_n"), F.posexplode(every).alias("pos", "h"))
    hits = None
    for p in range(passes):
        known = item_windows if passes == 1 else item_windows.filter(F.pmod(F.xxhash64("_item", "ipos", "h"), F.lit(passes)) == p)
        found = windows.join(F.broadcast(known), "h").select("_id", "_th", "_item", "item_words", "written", "ipos", F.when(F.col("written"), F.col("pos") - F.col("_n")).otherwise(F.col("pos")).alias("pos"))
        # with several passes each is written before the next, so that one broadcast lives at a time
        found = materialize(found, "pass") if passes > 1 else found
        hits = found if hits is None else hits.unionByName(found)
    keys = ["_id", "_th", "_item", "item_words"]
    grouped = hits.groupBy(*keys, "written", (F.col("pos") - F.col("ipos")).alias("offset")).agg(F.collect_set("ipos").alias("ps"))
    both = materialize(grouped.withColumn("ps", F.array_sort("ps")), "offsets")
    offsets = both.filter("not written").drop("written")

    hit_docs = offsets.select(F.col("_id").alias("_hid"), F.col("_th").alias("_hth")).distinct()
    match = F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_th") == F.col("_hth"))
    hit_text = source.withColumn("_th", F.xxhash64("_dt")).join(hit_docs, match, "left_semi").dropDuplicates(["_id", "_th"])
    doc_slots = slots(canonical(hit_text, F.col("_dt"), "_id", "_th"), "_id", "_th")
    item_slots = slots(item_cut, "_item").select("_item", F.col("pos").alias("ipos"), F.col("kind").alias("ikind"), F.col("value").alias("ivalue"))
    inside = F.expr(f"exists(ps, p -> ipos >= p and ipos < p + {WINDOW})")
    placed = offsets.join(item_slots, "_item").filter(inside).select(*keys, "offset", "ikind", "ivalue", (F.col("ipos") + F.col("offset")).alias("at"))
    same = F.col("x._id").eqNullSafe(F.col("s._id")) & (F.col("x._th") == F.col("s._th")) & (F.col("x.at") == F.col("s.pos")) & (F.col("x.ikind") == F.col("s.kind"))
    filled = placed.alias("x").join(doc_slots.alias("s"), same).select(*(f"x.{k}" for k in (*keys, "offset", "ikind", "ivalue")), (F.col("x.at") - F.col("x.offset")).alias("ipos"), "s.value")
    gathered = filled.groupBy(*keys, "offset").agg(F.array_sort(F.collect_list(F.struct("ipos", "ikind", "ivalue", "value"))).alias("found"))
    # ends of every two slots that give one value of the item two values; they matter to windows that hold both
    near = f" and t.ipos - s.ipos < {WINDOW}" if by_window else ""
    clash = f"flatten(transform(found, s -> transform(filter(found, t -> t.ipos > s.ipos{near} and t.ikind = s.ikind and t.ivalue = s.ivalue and t.value <> s.value), t -> named_struct('a', s.ipos, 'z', t.ipos))))"
    checked = gathered.withColumn("clashes", F.expr(clash))
    checked = checked.select(F.col("_id").alias("c_id"), F.col("_th").alias("c_th"), F.col("_item").alias("c_item"), F.col("offset").alias("c_offset"), "found", "clashes")
    on = F.col("_id").eqNullSafe(F.col("c_id")) & (F.col("_th") == F.col("c_th")) & F.col("_item").eqNullSafe(F.col("c_item")) & (F.col("offset") == F.col("c_offset"))
    sound_windows = f"filter(ps, p -> clashes is null or not exists(clashes, c -> c.a >= p and c.z < p + {WINDOW}))" if by_window else "case when coalesce(size(clashes), 0) > 0 then slice(ps, 1, 0) else ps end"
    sound = offsets.join(checked, on, "left").withColumn("ps", F.expr(sound_windows)).filter(F.size("ps") > 0)
    sound = sound.withColumn("n", F.expr(f"case when found is null then 0 else size(filter(found, s -> exists(ps, p -> s.ipos >= p and s.ipos < p + {WINDOW}))) end"))
    verbatim = both.filter("written").withColumn("n", F.lit(0))
    every = sound.select(*keys, "offset", "ps", "n", F.lit(False).alias("written")).unionByName(verbatim.select(*keys, "offset", "ps", "n", "written"))
    whole = every.groupBy(*keys, "written").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("ps"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_slots"),
        F.min(F.array_min("ps") + F.col("offset")).alias("a"), F.max(F.array_max("ps") + F.col("offset") + WINDOW - 1).alias("z"),
    )
    covered = F.expr(f"aggregate(ps, named_struct('n', {WINDOW}, 'last', ps[0]), (a, x) -> named_struct('n', a.n + least({WINDOW}, x - a.last), 'last', x), a -> a.n)")
    kept = whole.withColumn("covered", covered).filter(F.col("covered") >= F.least(F.lit(MIN_COVERED), F.col("item_words")))
    best = kept.groupBy("_id", "_th", "_item").agg(F.max(F.struct("covered", ~F.col("written"), "item_words", "a", "z")).alias("b"), F.max("n_slots").alias("n_slots"))
    return best.select(
        F.col("_id").alias(id_col), F.col("_item").alias(item_col), *(F.col(f"b.{c}").cast("bigint").alias(n) for c, n in (("covered", "covered"), ("item_words", "item_words"), ("a", "first_word"), ("z", "last_word"))), "n_slots", F.col("_th").alias("text_hash")
    )


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), by_window=True)
