"""Quality rules: base text statistics, then robust multivariate outliers per language and source.

Statistics are native column expressions over whole texts. The outlier rule
estimates the minimum covariance determinant of transformed statistic vectors
by concentration steps: each step ranks all documents of a group by Mahalanobis
distance, keeps the closer half and estimates centre and scatter again. Three
starts are concentrated until their determinants fall no more, and the smallest
one's estimates count. Ranks come from counts over fixed distance bins, so a group of
any size needs only partial aggregates; no row is collected, sampled or sorted.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, table, text_of, words_of

MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Documents a (language, source) group needs for estimates of its own; smaller ones use their language's, or all documents'.
MIN_GROUP = 60
#: The group of all documents; no group's name starts like it.
WHOLE = "*"
#: Concentration steps at most; a start ends as soon as its log determinant falls by no more than SETTLED.
STEPS, SETTLED = 12, 1e-9
#: Starts: medians with the floors as scales; mean and scatter of all; mean and scatter of deviations drawn in to within a floor.
STARTS = 3
#: Share of clean documents that the cutoff may cost: less than one of the 5e10 documents in 100 TB.
CLEAN_LOSS = 2e-11
#: Smallest standard deviation of each transformed statistic; keeps the scatter regular where half of a group is constant.
FLOORS = (0.30, 0.08, 0.35, 0.50, 0.35)
#: Consistency factor of the half-sample scatter for five normal dimensions.
CONSISTENCY = 1.0 / 0.4378
#: Bins per unit of the log distance, and per unit of a statistic for the starting medians.
BINS, MEDIAN_BINS = 40, 50
P = 5
#: The log determinant of a start, which is not of half a group and so compares with none; a start goes on while its own falls.
UNJUDGED, FALLS = 1e300, f"det < was - {SETTLED!r}"


def chi_square_cutoff(tail: float) -> float:
    """The value that chi-square of P = 5 degrees of freedom exceeds with probability tail."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        over = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        low, high = (x, high) if over > tail else (low, x)
    return round(high, 3)


#: Squared distance beyond which a document is rejected.
CUTOFF = chi_square_cutoff(CLEAN_LOSS)
#: Group estimates (about 250 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_GROUPS, SALTS = 150_000, 64
GROUP = ("lang", "source")


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = GROUP) -> DataFrame:
    """id, keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, base_failed.

    A null text counts as empty. Repeated three-word windows are found by
    sorting 64-bit words that hold a window's hash above its position; equal
    neighbours are compared word by word, so a hash collision never counts.
    """
    text = text_of(docs, text_col)
    one = docs.select(F.col(id_col), *keep, text.alias("_t"), words_of(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.select(
        id_col, *keep, "_w", F.size("_w").alias("_n"), lines.alias("_l"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"[A-Z]")).cast("bigint").alias("n_upper"),
    )
    windows = F.expr("case when _n >= 3 then transform(sequence(0, _n - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) else cast(array() as array<bigint>) end")
    three = two.select("*", windows.alias("_h"), F.expr("shiftleft(1L, length(bin(_n)))").alias("_m"))
    packed = "sort_array(transform(_h, (h, i) -> h - pmod(h, _m) + i))"
    four = three.withColumn("_s", F.expr(f"case when size(array_distinct(_h)) < size(_h) then {packed} else cast(array() as array<bigint>) end"))
    equal = lambda a, b: (
        f"({a} - pmod({a}, _m) = {b} - pmod({b}, _m) and " + " and ".join(f"_w[cast(pmod({a}, _m) as int) + {j}] = _w[cast(pmod({b}, _m) as int) + {j}]" for j in range(3)) + ")"
    )
    flagged = f"filter(_s, (x, k) -> (k > 0 and {equal('x', '_s[k - 1]')}) or (k < size(_s) - 1 and {equal('x', '_s[k + 1]')}))"
    five = four.withColumn("_f", F.expr(f"sort_array(transform({flagged}, x -> cast(pmod(x, _m) as int)))"))
    repeat = "case when size(_f) = 0 then 0L else aggregate(_f, named_struct('n', 3L, 'last', _f[0]), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n) end"
    six = five.select(
        id_col, *keep, F.col("_n").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.expr(repeat).alias("n_repeat_words"), F.size("_l").cast("bigint").alias("n_lines"), "n_upper",
    )
    return six.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


#: The transformed statistics, in SQL that Spark and DuckDB share: length, mean word, symbols, repeated lines, capitals.
#: Empty texts, which the base rules reject anyway, must not divide by zero.
VECTOR = (
    "ln(greatest(n_words, 1) * 1.0D)",
    "ln(greatest(word_chars, 1) * 1.0D / greatest(n_words, 1))",
    "ln(1 + 100.0D * n_symbols / greatest(n_words, 1))",
    "ln(1 + 100.0D * n_dup_lines / greatest(n_lines, 1))",
    "ln(1 + 100.0D * n_upper / greatest(word_chars, 1))",
)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Squared Mahalanobis distance from centre c and the inverse Cholesky factor v.
DISTANCE = " + ".join("power(" + " + ".join(f"v{i}{j} * (x{j} - c{j})" for j in range(i + 1)) + ", 2)" for i in range(P))
BIN = f"cast(floor({BINS} * ln(({DISTANCE}) + 1e-6)) as bigint)"
MOMENTS = ["count(*) as n", *(f"sum({x}) as s{i}" for i, x in enumerate(X)), *(f"sum(x{i} * x{j}) as s{i}{j}" for i, j in PAIRS)]
#: Centre, regularised scatter, its Cholesky factor l and the inverse v, each alias using earlier ones.
SOLVE = [f"s{i} / n as c{i}" for i in range(P)]
SOLVE += [f"(s{i}{j} / n - c{i} * c{j}) * {CONSISTENCY!r}" + (f" + {FLOORS[i] ** 2!r}" if i == j else "") + f" as a{i}{j}" for i, j in PAIRS]
for _i, _j in PAIRS:
    _rest = "".join(f" - l{_i}{_k} * l{_j}{_k}" for _k in range(_j))
    SOLVE.append(f"sqrt(a{_i}{_i}{_rest}) as l{_i}{_i}" if _i == _j else f"(a{_i}{_j}{_rest}) / l{_j}{_j} as l{_i}{_j}")
for _i, _j in PAIRS:
    _sum = " + ".join(f"l{_i}{_k} * v{_k}{_j}" for _k in range(_j, _i))
    SOLVE.append(f"1 / l{_i}{_i} as v{_i}{_i}" if _i == _j else f"-({_sum}) / l{_i}{_i} as v{_i}{_j}")
SOLVE.append("2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(P)) + ") as det")
PARAMETERS = [f"c{i}" for i in range(P)] + [f"v{i}{j}" for i, j in PAIRS]
#: A statistic with its deviation from the centre drawn in to within a floor.
DRAWN = [f"c{i} + (x{i} - c{i}) / (1 + abs(x{i} - c{i}) / {FLOORS[i]!r})" for i in range(P)]
START = [f"1 / {FLOORS[i]!r} as v{i}{j}" if i == j else f"0.0D as v{i}{j}" for i, j in PAIRS]


def _cut(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The first bin by which half of a group's rows are reached; the bins of a group are few.

    The counts are written first: else Spark would deal every task's partial
    counts by group for the window, and a large group's would meet in one task.
    """
    histogram = materialize(histogram, "histogram")
    w = Window.partitionBy(*keys)
    run = histogram.withColumns({"_c": F.sum("n").over(w.orderBy("bin")), "_n": F.sum("n").over(w)})
    return run.filter(2 * F.col("_c") >= F.col("_n")).groupBy(*keys).agg(F.min("bin").alias("cut"))


def estimates(vectors: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre and inverse Cholesky factor per g, from vectors(g, x0..x4): of the starts, concentrated, the one of smallest determinant."""
    long = vectors.selectExpr("g", f"stack({P}, {', '.join(f'{i}, {x}' for i, x in enumerate(X))}) as (i, x)")
    histogram = long.groupBy("g", "i", F.floor(F.col("x") * MEDIAN_BINS).alias("bin")).agg(F.count("*").alias("n"))
    centre = _cut(histogram, ["g", "i"]).groupBy("g")
    middle = materialize(centre.agg(*(F.max(F.when(F.col("i") == i, (F.col("cut") + 0.5) / MEDIAN_BINS)).alias(f"c{i}") for i in range(P))), "middle")
    # where the estimates are too many to broadcast, the join deals rows by g; the salt then brings a shuffle of
    # partial sums behind it, so that a large group's rows are split and never summed in one task
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)))
    sums = [m.split(" as ")[1] for m in MOMENTS]

    # no later table has more rows than a start for each group
    small = STARTS * middle.count() <= BROADCAST_GROUPS

    def joinable(estimate: DataFrame) -> DataFrame:
        return F.broadcast(estimate) if small else materialize(estimate, "mcd")

    def solved(rows: DataFrame) -> DataFrame:
        partial = rows.groupBy("g", "k", "salt").agg(*(F.expr(m) for m in MOMENTS), F.max("det").alias("was"))
        moments = partial.groupBy("g", "k").agg(*(F.sum(c).alias(c) for c in sums), F.max("was").alias("was"))
        return moments.selectExpr("g", "k", "was", *SOLVE).select("g", "k", "was", "det", *PARAMETERS)

    drawn = salted.join(joinable(middle), "g").selectExpr("g", "salt", "2 as k", *(f"{e} as {x}" for e, x in zip(DRAWN, X, strict=True)))
    others = solved(salted.withColumn("k", F.lit(1)).unionByName(drawn).withColumn("det", F.lit(UNJUDGED))).drop("was", "det")
    medians = middle.selectExpr("g", "0 as k", *(f"c{i}" for i in range(P)), *START)
    going, passed = materialize(medians.unionByName(others).withColumn("det", F.lit(UNJUDGED)), "mcd"), []
    for _ in range(steps):
        placed = salted.join(joinable(going), "g").selectExpr("g", "k", "salt", f"{BIN} as bin")
        counted = placed.groupBy("g", "k", "bin", "salt").agg(F.count("*").alias("n")).groupBy("g", "k", "bin").agg(F.sum("n").alias("n"))
        cut = going.join(_cut(counted, ["g", "k"]), ["g", "k"])
        inner = salted.join(joinable(cut), "g").filter(F.expr(f"{BIN} <= cut"))
        passed.append(materialize(solved(inner), "mcd"))
        going = passed[-1].filter(FALLS)
        if going.isEmpty():
            break
    every = reduce(DataFrame.unionByName, passed)
    best = every.groupBy("g").agg(F.min_by(F.struct(*PARAMETERS), F.struct("det", "k")).alias("best"))
    return materialize(best.select("g", "best.*"), "mcd")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: tuple[str, str] = GROUP, min_group: int = MIN_GROUP, cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of docs: the base statistics, base_failed, kept, distance and text_hash, which with the id names the document.

    Estimates use the documents that pass the base rules. A (language, source)
    group with fewer than min_group of them is judged by the estimates of its
    whole language, and where that is smaller too by those of all documents;
    only a table with fewer than min_group of them rejects nothing beyond the
    base rules. Null language or source is a group like any other; a null or
    empty text fails the base rules; repeated rows each get their row; an empty
    table gives an empty result. Other columns of docs are not read.
    """
    lang, source = group
    own_columns = (F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"), F.xxhash64(text_of(docs, text_col)).alias("_th"))
    renamed = docs.select(F.col(id_col).alias("_id"), *own_columns, F.col(text_col).alias("_text"))
    stats = materialize(base_statistics(renamed, "_id", "_text", ("_lang", "_source", "_th")), "statistics")
    mark = F.concat(F.coalesce(F.concat(F.lit("="), "_lang"), F.lit("-")), F.lit("\x01"))
    own = F.concat(mark, F.coalesce(F.concat(F.lit("="), "_source"), F.lit("-")))
    good = stats.filter(~F.col("base_failed")).withColumns({"_own": own, "_pool": mark})
    counts = materialize(good.groupBy("_own", "_pool").agg(F.count("*").alias("_n")), "counts")
    pools = counts.groupBy("_pool").agg(F.sum("_n").alias("_pn"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    whole = F.lit(WHOLE if total >= min_group else None).cast("string")
    keyed = counts.join(pools, "_pool").withColumn("g", F.when(F.col("_n") >= min_group, F.col("_own")).when(F.col("_pn") >= min_group, F.col("_pool")).otherwise(whole))
    keyed = materialize(keyed, "keyed")
    # a document counts for its own estimates and for those of every pool that some group is judged by
    used = materialize(keyed.groupBy("g").agg(F.count("*").alias("_u")), "used")
    needed = used.select(F.col("g").alias("_pool"), F.col("g").alias("_pg"))
    by_all = F.lit(WHOLE if used.filter(F.col("g") == WHOLE).count() else None).cast("string")
    own_group = F.when(F.col("_n") >= min_group, F.col("_own"))
    groups = materialize(keyed.join(needed, "_pool", "left").select("_own", "g", F.array_compact(F.array(own_group, F.col("_pg"), by_all)).alias("for")), "groups")
    placed = good.join(groups, "_own").withColumn("g", F.explode("for"))
    vectors = placed.selectExpr("g", *(f"{e} as {x}" for e, x in zip(VECTOR, X, strict=True)))
    found = estimates(materialize(vectors, "vectors"))
    limits = materialize(groups.drop("for").join(found, "g").drop("g"), "limits")
    scored = stats.withColumn("_own", own).join(limits, "_own", "left").selectExpr("*", *(f"{e} as {x}" for e, x in zip(VECTOR, X, strict=True)))
    scored = scored.withColumn("distance", F.when(~F.col("base_failed"), F.expr(DISTANCE)))
    return scored.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "n_lines", "n_upper", "distance", F.col("_th").alias("text_hash"),
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("distance", "text_hash")


def _solve_in_levels(source: str) -> str:
    """SOLVE over a table as nested selects, as DuckDB writes out an alias anew wherever the same select uses it."""
    level, levels = {}, {}
    for item in SOLVE:
        expression, name = item.rsplit(" as ", 1)
        level[name] = 1 + max((level[x] for x in re.findall(r"\w+", expression) if x in level), default=0)
        levels.setdefault(level[name], []).append(item)
    for k in sorted(levels):
        source = f"(select *, {', '.join(levels[k])} from {source})"
    return source


def _oracle() -> str:
    vector = ", ".join(f"{e} as {x}" for e, x in zip(VECTOR, X, strict=True))
    half = "qualify 2 * sum(n) over (partition by {k} order by bin) >= sum(n) over (partition by {k})"
    ctes = [
        """w as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents)""",
        """win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3))""",
        """rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p
            from (select *, count(*) over (partition by doc_id, g) as c from win) where c > 1) group by 1)""",
        """st0 as (select doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
            len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '[A-Z]')) as n_upper,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w)""",
        f"""st as (select st0.* exclude (ls), (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
            n_words < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * n_words as base_failed,
            coalesce('=' || lang, '-') || chr(1) as pool, coalesce('=' || lang, '-') || chr(1) || coalesce('=' || source, '-') as own from st0 left join rep using (doc_id))""",
        "cnt as (select own, pool, count(*) as n from st where not base_failed group by all)",
        "pn as (select pool, sum(n) as pn from cnt group by 1)",
        f"""gr as (select own, pool, n, case when n >= {MIN_GROUP} then own when pn >= {MIN_GROUP} then pool when (select sum(n) from cnt) >= {MIN_GROUP} then '{WHOLE}' end as g
            from cnt join pn using (pool))""",
        f"""vec as (select unnest(list_distinct([case when n >= {MIN_GROUP} then own end, case when gr.pool in (select g from gr) then gr.pool end,
            case when '{WHOLE}' in (select g from gr) then '{WHOLE}' end])) as g, {vector} from st join gr using (own) where not base_failed)""",
        f"""h0 as (select g, i, floor(x * {MEDIAN_BINS}) as bin, count(*) as n from (select g, unnest(range({P})) as i, unnest([{", ".join(X)}]) as x from vec) group by all)""",
        f"m0 as (select g, i, min(bin) as cut from (select * from h0 {half.format(k='g, i')}) group by all)",
        f"md as (select g, {', '.join(f'max(case when i = {i} then (cut + 0.5) / {MEDIAN_BINS} end) as c{i}' for i in range(P))} from m0 group by g)",
        f"""s12 as (select g, 1 as k, {", ".join(X)} from vec union all
            select g, 2, {", ".join(DRAWN)} from vec join md using (g))""",
        f"q0 as (select g, k, {', '.join(MOMENTS)} from s12 group by all)",
        f"""a0 as (select *, {UNJUDGED!r} as det from (select g, 0 as k, {", ".join(PARAMETERS[:P])}, {", ".join(START)} from md
            union all select g, k, {", ".join(PARAMETERS)} from {_solve_in_levels("q0")}))""",
    ]
    for k in range(STEPS):
        ctes += [
            f"h{k + 1} as (select g, k, {BIN} as bin, count(*) as n from vec join a{k} using (g) group by all)",
            f"t{k + 1} as (select g, k, min(bin) as cut from (select * from h{k + 1} {half.format(k='g, k')}) group by g, k)",
            f"q{k + 1} as (select g, k, max(det) as was, {', '.join(MOMENTS)} from vec join a{k} using (g) join t{k + 1} using (g, k) where {BIN} <= cut group by g, k)",
            f"e{k + 1} as (select g, k, was, det, {', '.join(PARAMETERS)} from {_solve_in_levels(f'q{k + 1}')})",
            f"a{k + 1} as (select * from e{k + 1} where {FALLS})",
        ]
    passed = " union all ".join(f"select * from e{k + 1}" for k in range(STEPS))
    ctes.append(f"best as (select * from ({passed}) qualify row_number() over (partition by g order by det, k) = 1)")
    ctes.append(f"d as (select st.*, {vector}, best.* exclude (g) from st left join (select own, g from gr) using (own) left join best using (g) where not base_failed)")
    tail = f"""select st.doc_id, st.n_words, st.word_chars, st.n_symbols, st.n_dup_lines, st.n_repeat_words, st.base_failed,
      not st.base_failed and coalesce(x.ok, true) as kept, st.n_lines, st.n_upper
      from st left join (select doc_id, coalesce({DISTANCE} <= {CUTOFF}, true) as ok from d) x using (doc_id)"""
    return ("with " + ",\n".join(f"{c.split(' as ', 1)[0]} as materialized {c.split(' as ', 1)[1]}" for c in ctes) + tail).replace("0D", "0")


ORACLE = _oracle()
