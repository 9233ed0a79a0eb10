"""Personal data: base patterns, and identifiers that their contexts give away.

Everything is DataFrame expressions. Known identifiers are seeds; the words around them
become patterns; patterns and identifiers score each other in rounds; what stands in a
trusted context and has the shape of an identifier is found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsieve.llm.tables import written
from rowsieve.operators.small import join_small
from rowsieve.session import checkpointed

# The kinds in the order of the result, with their base patterns. Possessive
# repeats and the start condition (the end of the last match, or no such character before)
# match the same text as the plain forms in one pass, whatever its length.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Where unseen identifiers are looked for: words around a written-out at sign, of which up
#: to two spaces are part, or a word that holds a digit or an at sign.
AT = r"(?:@|[(\[](?i:at)[)\]])"
TOKEN = (
    r"(?<![^\x20\x09-\x0D])(?:[\x22'(\[<]*+[A-Za-z0-9._%+-]{2,}+\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]{2}[^\x20\x09-\x0D]*+"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
#: What may stand before and after an identifier; a bracket around leading digits is part of it.
LEAD = r"^(?:[\x22'\[<]|\((?![0-9]{1,5}\)))+"
TAIL = r"[\x22')\]>,;:!?.]+$"
#: Words that together may be one number: digits with signs inside, at most so many.
PART = r"^[\x22'(\[<]*[0-9][0-9()./_-]*[\x22')\]>,;:!?.]*$"
RUN = 4

SPAN = "struct<kind:int,start:int,end:int>"
WINDOW = 96
STEP = 0.01
MIN_SUPPORT = 3
MIN_LIFT = 4.0
MIN_SCORE = 0.8


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, at: Column) -> Column:
        value = F.substr(F.reverse(digits), at, F.lit(1)).cast("int")
        double = value * 2 - F.when(value > 4, 9).otherwise(0)
        return total + F.when(at % 2 == 0, double).otherwise(value)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _is_card(text: Column) -> Column:
    digits = _digits(text)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _is_ip(text: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 2) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(text, "[.]"), small)


VALID = {
    "email": lambda text: F.lit(True),
    "ip": _is_ip,
    "card": _is_card,
    "phone": lambda text: F.length(_digits(text)).between(9, 15),
}


def _places(text: Column, pattern: str, keep, make) -> Column:
    """``make(match, start, end)`` of each match that ``keep`` takes, in code points.

    The text between matches gives their places: lengths are added up from match to match.
    """
    # What lies before each match beside the match; the rest after the last has none.
    rows = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda match, before: F.struct(match.alias("match"), F.length(before).alias("before")),
    )
    found = make(F.lit(""), F.lit(0), F.lit(0))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["before"]
        end = start + F.coalesce(F.length(row["match"]), F.lit(0))
        new = F.array(make(row["match"], start, end))
        taken = F.coalesce(row["match"].isNotNull() & keep(row["match"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(taken, F.concat(state["found"], new)).otherwise(state["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.filter(F.array(found), lambda _: F.lit(False)).alias("found"))
    return F.aggregate(rows, zero, step, lambda state: state["found"])


def _base_spans(text: Column) -> Column:
    """All base spans by kind, then start."""
    cues = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for order, kind in enumerate(KINDS):

        def make(_, start, end, order=order):
            return F.struct(F.lit(order).alias("kind"), start.alias("start"), end.alias("end"))

        spans = _places(text, BASE[kind], VALID[kind], make)
        found.append(F.when(cues[kind], spans).otherwise(none))
    return F.concat(*found)


def _shape(word: Column) -> Column:
    """The kind an unseen word, or a run of numeric words, could be by its look, or null."""
    digits = F.length(_digits(word))
    numeric = word.rlike(r"^[(]?[0-9][\x200-9()./_-]*[0-9]$")
    return (
        F.when(word.rlike(rf"^[A-Za-z0-9._%+-]{{2,}}\x20?{AT}\x20?[A-Za-z0-9-]{{2,}}"), F.lit(0))
        .when(word.rlike(r"^(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}$"), F.lit(1))
        .when(numeric & digits.between(13, 19) & _is_card(word), F.lit(2))
        .when(numeric & digits.between(7, 12), F.lit(3))
    )


def _unseen(text: Column, base: Column) -> Column:
    """Words, or runs of up to ``RUN`` neighbouring numeric words, that look like an identifier.

    They touch no base span. The longest run from a word on that has the shape is taken.
    """

    def make(match: Column, start: Column, end: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), match.alias("word"))

    bare = lambda word: F.regexp_replace(F.regexp_replace(word, LEAD, ""), TAIL, "")
    part = lambda word: word.rlike(PART)
    words = _places(text, TOKEN, lambda word: part(word) | _shape(bare(word)).isNotNull(), make)
    free = lambda row: ~F.exists(base, lambda span: (span["start"] < row["end"]) & (row["start"] < span["end"]))
    none = F.array().cast(f"array<{SPAN}>")

    def run(some: Column) -> Column:
        """The span of a run of words, or null: words apart, or no shape together."""
        joined = F.array_join(F.transform(some, lambda row: row["word"]), " ")
        # Two words are neighbours if at most two characters, both blank, are between them.
        gaps = F.zip_with(some, F.slice(some, 2, RUN), lambda a, b: F.coalesce(b["start"] - a["end"] <= 2, F.lit(True)))
        whole = F.forall(gaps, lambda near: near) & (F.forall(some, lambda row: part(row["word"])) | (F.size(some) == 1))

        def span(kind: Column) -> Column:
            first, last = F.get(some, F.lit(0)), F.element_at(some, -1)
            start = first["start"] + F.length(first["word"]) - F.length(F.regexp_replace(first["word"], LEAD, ""))
            end = last["end"] - F.length(joined) + F.length(F.regexp_replace(joined, TAIL, ""))
            return F.struct(kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"))

        kinds = F.filter(F.array(F.when(whole, _shape(bare(joined)))), lambda kind: kind.isNotNull())
        return F.transform(kinds, span)

    def spans(held: Column) -> Column:
        # Each word with the longest run that it begins, and its number of words.
        def begun_at(at: Column, length: int) -> Column:
            some = F.slice(held, at, length)
            after = (at + length).cast("int").alias("next")
            found = F.when(F.size(some) == length, run(some)).otherwise(none)
            return F.transform(found, lambda span: F.struct(span.alias("span"), after))

        def longest(at: Column) -> Column:
            runs = [begun_at(at, length) for length in range(RUN, 0, -1)]
            return F.struct(at.cast("int").alias("at"), F.slice(F.concat(*runs), 1, 1).alias("run"))

        begun = F.filter(F.transform(F.sequence(F.lit(1), F.size(held)), longest), lambda row: F.size(row["run"]) > 0)

        def take(state: Column, row: Column) -> Column:
            first = F.get(row["run"], F.lit(0))
            return F.when(row["at"] < state["next"], state).otherwise(
                F.struct(first["next"].alias("next"), F.concat(state["found"], F.array(first["span"])).alias("found"))
            )

        zero = F.struct(F.lit(0).alias("next"), none.alias("found"))
        return F.aggregate(begun, zero, take, lambda state: state["found"])

    # One element, so that the words are looked for once.
    held = F.transform(F.array(F.filter(words, free)), lambda held: F.when(F.size(held) > 0, spans(held)).otherwise(none))
    cue = text.rlike(rf"[0-9]|{AT}")
    return F.when(cue, F.get(held, F.lit(0))).otherwise(none)


def _contexts(text: Column, spans: Column, seed: bool) -> Column:
    """Each span with the text itself and the words on both sides, nearest first."""
    clean = r"[^\p{L}]+"

    def word_list(part: Column) -> Column:
        return F.filter(F.split(F.lower(part), clean, -1), lambda word: word != "")

    def row(span: Column) -> Column:
        start = F.greatest(span["start"] - WINDOW, F.lit(0))
        left = F.substr(text, start + 1, span["start"] - start)
        right = F.substr(text, span["end"] + 1, F.lit(WINDOW))
        return F.struct(
            F.lit(seed).alias("seed"),
            span["kind"].alias("kind"),
            span["start"].alias("start"),
            span["end"].alias("end"),
            F.xxhash64(F.lower(F.substr(text, span["start"] + 1, span["end"] - span["start"]))).alias("identifier"),
            F.reverse(word_list(left)).alias("left"),
            word_list(right).alias("right"),
        )

    return F.transform(spans, row)


def _patterns(side: str) -> Column:
    """Patterns of one side: the next word, the next two, and the same further away.

    Words at distance 3 to 7 tell how common a pattern is where it means nothing.
    """
    words = F.col(side)

    def pair(at: int) -> Column:
        return F.concat_ws(" ", F.slice(words, at, 2))

    def pattern(name: str, text: Column, distance: int) -> Column:
        return F.struct(F.concat(F.lit(f"{side} {name} "), text).alias("pattern"), F.lit(distance).alias("distance"))

    rows = []
    for distance in (1, *FAR):
        rows += [pattern("1", F.get(words, F.lit(distance - 1)), distance), pattern("2", pair(distance), distance)]
    return F.array(*rows)


FAR = (3, 4, 5, 6, 7)


def _evidence(graph: DataFrame) -> DataFrame:
    """(kind, pattern, identifier, seed, free, near) next to patterns that can stand out.

    An identifier counts once per pattern and distance, however many copies of its text there
    are. Lift compares how often the pattern stands next to identifiers and further away from
    them; it depends on no score.
    """
    each = graph.groupBy("kind", "pattern", "distance", "identifier").agg(
        F.max(F.col("seed").cast("double")).alias("seed"), F.max(~F.col("seed")).alias("free")
    )
    near = F.col("distance") == 1
    lifted = (
        each.groupBy("kind", "pattern")
        .agg(F.sum(F.when(near, 1.0).otherwise(0.0)).alias("near"), F.sum(F.when(~near, 1.0).otherwise(0.0)).alias("far"))
        .where((F.col("near") >= MIN_SUPPORT) & (F.col("near") >= MIN_LIFT * F.col("far") / len(FAR)))
    )
    return checkpointed(
        each.where(near).join(lifted, ["kind", "pattern"]).select("kind", "pattern", "identifier", "seed", "free", "near")
    )


def _score_patterns(scored: DataFrame) -> DataFrame:
    """(kind, pattern, trust) of patterns with enough support, from evidence and its scores.

    Support is the sum of the scores of a pattern's identifiers, trust their mean (with one
    unknown added).
    """
    return (
        scored.groupBy("kind", "pattern")
        .agg(F.sum("score").alias("support"), F.max("near").alias("near"))
        .where(F.col("support") >= MIN_SUPPORT)
        .select("kind", "pattern", (F.col("support") / (F.col("near") + 1)).alias("trust"))
    )


def _discover(instances: DataFrame) -> DataFrame:
    """(row, kind, start, end) of unseen words whose contexts are trusted.

    ``instances``: one row per span with its seed mark and context words. Each round scores
    patterns by the identifiers in them and unseen words by their best pattern. Scores only
    rise; rounds end when none has risen by more than ``STEP``.
    """
    patterns = F.explode(F.concat(_patterns("left"), _patterns("right"))).alias("found")
    graph = checkpointed(
        instances.select("row", "kind", "start", "end", "seed", "identifier", patterns)
        .select("row", "kind", "start", "end", "seed", "identifier", "found.*")
        .where(F.col("pattern").isNotNull() & ~F.col("pattern").endswith(" "))
    )
    evidence = _evidence(graph)
    scores = checkpointed(evidence.select("kind", "identifier", F.lit(0.0).alias("score")).limit(0))
    moved = True
    while moved:
        known = scores.withColumnRenamed("score", "better")
        scored = evidence.join(known, ["kind", "identifier"], "left").withColumn(
            "score", F.greatest("seed", F.coalesce("better", F.lit(0.0)))
        )
        trusted = _score_patterns(scored)
        scores = checkpointed(
            scored.where("free")
            .join(trusted, ["kind", "pattern"])
            .groupBy("kind", "identifier")
            .agg(F.max("trust").alias("score"), (F.max("trust") - F.coalesce(F.max("better"), F.lit(0.0))).alias("rise"))
        )
        moved = not scores.where(F.col("rise") > STEP).isEmpty()
        scores = scores.drop("rise")
    sure = scores.where(F.col("score") >= MIN_SCORE)
    unseen = graph.where(~F.col("seed") & (F.col("distance") == 1))
    return unseen.join(sure, ["kind", "identifier"]).select("row", "kind", "start", "end").distinct()


def _with_spans(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """``kept`` columns of every document with (row, base, added), all written once."""
    text = F.coalesce(docs["text"], F.lit(""))
    held = docs.select(*kept, text.alias("_text")).withColumn("base", _base_spans(F.col("_text")))
    held = held.withColumn("unseen", _unseen(F.col("_text"), F.col("base"))).withColumn(
        "contexts",
        F.concat(_contexts(F.col("_text"), F.col("base"), True), _contexts(F.col("_text"), F.col("unseen"), False)),
    )
    rows = written(held.drop("_text", "unseen").withColumn("row", F.monotonically_increasing_id()), "spans")
    instances = rows.select("row", F.explode("contexts").alias("at")).select("row", "at.*")
    span = F.struct(F.col("kind"), F.col("start"), F.col("end"))
    found = _discover(instances).groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("added"))
    none = F.array().cast(f"array<{SPAN}>")
    # Few rows gain spans as a rule; their measured size decides how they are joined.
    return join_small(rows.drop("contexts"), found, "row").withColumn("added", F.coalesce("added", none))


def _written_out(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``.

    Counts and hash are of the base spans; ``spans`` lists them with what the contexts add.
    Null and empty texts have no spans. Repeated rows are judged each; their identifiers
    count once as evidence. Other columns play no part, whatever their names.
    """
    rows = _with_spans(docs, [docs["doc_id"]])

    def count(order: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == order)).cast("long")

    return rows.select(
        "doc_id",
        *(count(order).alias(f"n_{kind}") for order, kind in enumerate(KINDS)),
        F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"),
        _written_out(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets.

    Overlapping spans are replaced from the first start to the last end. ``n_chars``, where
    there is such a column, follows the new text; null texts and all else stay as they are.
    """
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    rows = _with_spans(docs, [whole])
    text = F.col("_row.text")
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    places = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )

    def step(state: Column, span: Column) -> Column:
        before = F.substr(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        name = F.when(span["start"] >= state["at"], F.get(names, span["kind"])).otherwise("")
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], before, name).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substr(text, state["at"] + 1, F.length(text)))
    masked = F.when(F.size(places) > 0, F.aggregate(places, zero, step, rest)).otherwise(text)

    def column(name: str) -> Column:
        if name == "text":
            return F.col("_masked").alias(name)
        if name == "n_chars":
            old = F.col("_row.n_chars")
            new = F.length("_masked").cast(docs.schema[name].dataType)
            return F.when(F.col("_masked") != text, new).otherwise(old).alias(name)
        return F.col(f"_row.`{name}`").alias(name)

    return rows.withColumn("_masked", masked).select(*(column(c) for c in docs.columns))
