"""Sheet names made valid and unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowsieve.functions.names import SHEET_NAME_MAX, clean_sheet_name
from rowsieve.operators.chunk import numbered, running_sums
from rowsieve.operators.small import join_small
from rowsieve.session import checkpointed

# Fixed value: the first number tried after a taken name.
FIRST_SUFFIX = 2
NUMBERED = r" \(([2-9]|[1-9][0-9]{1,17})\)\z"
# A suffix in full or cut short, any number of times, at the end of a name.
SUFFIX_TAIL = r"( \(?[0-9]*\)?)+$"
# Numbers of a pool that are gone through in one place.
BLOCK = 1024
SHORTEST_BASE = SHEET_NAME_MAX - len(" (99999999)")


def name_stem(name: Column) -> Column:
    """Equal for a name and everything that adding suffixes to it can produce."""
    stripped = F.regexp_replace(F.lower(name), SUFFIX_TAIL, "")
    return F.regexp_replace(F.left(stripped, F.lit(SHORTEST_BASE)), SUFFIX_TAIL, "")


def sanitize_names(df: DataFrame, name: str, order, within=()) -> DataFrame:
    """Add ``sheet_name``: valid, and unlike all names given to earlier rows.

    Names must differ among rows that agree on ``within``, the workbook for example.
    A name can be taken only by one with the same base or by a numbered one, so a
    row's rank among those of its base is its number, however often a name repeats
    and however many tasks its rows are dealt to. Only where repeated names meet
    numbered ones, or names so long that a number cuts them short, are the rows of
    a stem settled in rounds, see ``_settle``; no stem's rows ever meet in one task.
    """
    cleaned = df.withColumn("_base", clean_sheet_name(F.col(name)))
    book = [f"_in{i}" for i in range(len(within))]
    slim = cleaned.select(*order, *[F.col(c).alias(b) for c, b in zip(within, book)], "_base").withColumn(
        "_group", F.struct(*book, F.lower("_base").alias("key"))
    )
    ranked = numbered(slim, ["_group", *order], "_group")
    suffix = F.concat(F.lit(" ("), F.col("_rn").cast("string"), F.lit(")"))
    with_number = F.concat(F.left("_base", F.lit(SHEET_NAME_MAX) - F.length(suffix)), suffix)
    ranked = ranked.withColumns(
        {
            "_stem": name_stem(F.col("_base")),
            "_given": F.when(F.col("_rn") == 1, F.col("_base")).otherwise(with_number),
            "_meets": F.col("_base").rlike(NUMBERED)
            | ((F.col("_rn") > 1) & (F.length("_base") + F.length(suffix) > SHEET_NAME_MAX)),
        }
    )
    stems = ranked.groupBy(F.struct(*book, "_stem").alias("_at")).agg(
        ((F.max("_rn") > 1) & F.max("_meets")).alias("_unsure")
    )
    flagged = join_small(ranked.withColumn("_at", F.struct(*book, "_stem")), stems.filter("_unsure"), "_at")
    unsure = F.coalesce("_unsure", F.lit(False))
    given = flagged.filter(~unsure).select(*order, "_given")
    meeting = checkpointed(flagged.filter(unsure))
    if not meeting.isEmpty():
        given = given.unionByName(_settle(meeting, order, book))
    return (
        cleaned.join(given, list(order), "left")
        .withColumn("sheet_name", F.coalesce("_given", "_base"))
        .drop("_base", "_given")
    )


def _first_number(digits: Column) -> Column:
    """The least number of that many digits that a suffix can hold."""
    return F.greatest(F.rpad(F.lit("1"), digits, F.lit("0")).cast("bigint"), F.lit(FIRST_SUFFIX).cast("bigint"))


def _prefix(digits: Column) -> Column:
    """What a name keeps before a suffix of that many digits."""
    return F.left("_base", F.lit(SHEET_NAME_MAX - len(" ()")) - digits)


def _settle(rows: DataFrame, order, book) -> DataFrame:
    """(order, ``_given``) of rows whose names can meet, in rounds over all of them.

    A name with a suffix of d digits is its prefix and a number, so rows with one prefix draw
    from one pool of numbers, in order. In a round each row asks for the best it can still
    have: the first of a name for the name itself (level 0), others for a number of ``_level``
    digits. Whoever comes later loses for good and asks for more digits; what nobody loses
    any more is final. As earlier rows always go first, this is what giving names one by one
    leads to. A round ranks whole pools, so rounds are few, however many rows a pool has.
    """
    digits = F.length(F.col("_rn").cast("string"))
    # Of equal names the n-th gets a number of n or more.
    state = rows.select(
        *order, *book, "_base", F.when(F.col("_rn") == 1, 0).otherwise(digits).alias("_level"),
        F.lit(0).cast("bigint").alias("_number"),
    )
    moving = True
    while moving:
        state = checkpointed(_next_round(state, order, book))
        moving = not state.where(F.col("_level") != F.col("_was")).isEmpty()
        state = state.drop("_was")
    suffix = F.concat(F.lit(" ("), F.col("_number").cast("string"), F.lit(")"))
    given = F.when(F.col("_level") == 0, F.col("_base")).otherwise(F.concat(_prefix(F.col("_level")), suffix))
    return state.select(*order, given.alias("_given"))


def _next_round(state: DataFrame, order, book) -> DataFrame:
    """``state`` with the level and number that each row gets against all rows as they ask now."""
    columns = [*state.columns, "_was"]
    state = state.withColumn("_was", F.col("_level"))
    wanted = F.regexp_extract("_base", NUMBERED, 1)
    member = F.col("_level") > 0
    asks = member | (wanted != "")
    digits = F.when(member, F.col("_level")).otherwise(F.length(wanted))
    at = F.struct(*book, digits.alias("digits"), F.lower(_prefix_of(member, wanted)).alias("prefix"))
    play = state.where(asks).withColumns({"_at": at, "_wanted": F.when(~member, wanted.cast("bigint"))})
    play = running_sums(play, ["_at", *order], "_at", {"_rank": member.cast("bigint")})
    first = _first_number(F.col("_at.digits"))
    # A name that is a number of a pool is taken if the members before its row, set on the
    # numbers from the first on that no other name holds, reach it.
    claims = play.where(~member).withColumn("_room", F.col("_wanted") - first - F.col("_rank"))
    held, lost = _decide(claims)
    marks = held.select("_at", (F.col("_wanted") - first - F.col("_held") + 1).alias("_rank"), F.lit(True).alias("_mark"))
    members = play.where(member).withColumn("_mark", F.lit(False))
    moved = running_sums(
        members.unionByName(marks, allowMissingColumns=True), ["_at", "_rank", F.desc("_mark")], "_at",
        {"_passed": F.col("_mark").cast("bigint")},
    ).where(~F.col("_mark"))
    moved = moved.withColumn("_number", first - 1 + F.col("_rank") + F.col("_passed"))
    # A number beyond the pool's last one tells how many digits the row will need at least.
    moved = moved.withColumn("_level", F.length(F.col("_number").cast("string")))
    return (
        state.where(~asks).select(*columns)
        .unionByName(held.select(*columns))
        .unionByName(lost.withColumn("_level", F.lit(1)).select(*columns))
        .unionByName(moved.select(*columns))
    )


def _prefix_of(member: Column, wanted: Column) -> Column:
    whole = F.left("_base", F.length("_base") - F.length(wanted) - F.lit(len(" ()")))
    return F.when(member, _prefix(F.col("_level"))).otherwise(whole)


def _decide(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``claims`` that hold, with ``_held`` (how many of smaller numbers do), and those that do not.

    One holds if its ``_room`` is not below ``_held``. Blocks of ``BLOCK`` numbers are gone
    through each on its own; more of a pool held before a block never means fewer held after
    it, so bounds of where blocks begin close in, and each round settles at least the next block.
    """
    names = claims.columns
    key = F.struct("_at", F.floor(F.col("_wanted") / BLOCK).alias("_block"))
    row = F.struct("_wanted", F.struct(*names).alias("row"))
    blocks = checkpointed(claims.groupBy(key.alias("_key")).agg(F.array_sort(F.collect_list(row)).alias("_rows")))

    def after(held: Column, claim: Column) -> Column:
        return F.when(claim["row"]["_room"] >= held, held + 1).otherwise(held)

    pool = Window.partitionBy("_key._at").orderBy("_key._block")
    sizes = F.sum(F.size("_rows").cast("bigint")).over(pool.rowsBetween(Window.unboundedPreceding, -1))
    none = F.lit(0).cast("bigint")
    starts = blocks.select("_key", none.alias("_least"), F.coalesce(sizes, none).alias("_most"))
    starts = checkpointed(starts)
    while not starts.where("_least < _most").isEmpty():
        ends = join_small(blocks, starts, "_key", materialised=True).select(
            "_key", "_least", "_most",
            F.aggregate("_rows", F.col("_least"), after).alias("_low"), F.aggregate("_rows", F.col("_most"), after).alias("_high"),
        )
        low, high = (F.coalesce(F.lag(c).over(pool), none) for c in ("_low", "_high"))
        starts = ends.select("_key", F.greatest("_least", low).alias("_least"), F.least("_most", high).alias("_most"))
        starts = checkpointed(starts)

    def step(state: Column, claim: Column) -> Column:
        now = after(state["held"], claim)
        return F.struct(now.alias("held"), F.concat(state["before"], F.array(state["held"])).alias("before"))

    zero = F.struct(F.col("_least").alias("held"), F.array().cast("array<bigint>").alias("before"))
    before = F.aggregate("_rows", zero, step, lambda state: state["before"])
    begun = join_small(blocks, starts, "_key", materialised=True).select("_rows", before.alias("_before"))
    each = begun.select(F.explode(F.arrays_zip("_rows", "_before")).alias("_at"))
    settled = checkpointed(each.select("_at._rows.row.*", F.col("_at._before").alias("_held")))
    holds = F.col("_room") >= F.col("_held")
    return settled.where(holds), settled.where(~holds)
