"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other values has the same
template. Windows of templates are hashed and joined with those of the benchmark. Hits on one alignment are
then checked: names must map to the document's one to one and units to one each, as they do when a question was
filled in anew and do not when a template fits by chance. Numbers may be equal in the benchmark by chance, so
theirs may differ. Windows that hold a slot that does not fit are left out, others count.

Only DataFrame functions run here. A text has three views. In the first a name is a run of capitalised words
inside a sentence, so a word that starts one is a plain word. In the second, runs of capitalised words are names
wherever they stand, and units need no number. The third has the words and numbers as they are, so that copies are
found whatever their letters' case. Letters are compared in lower case. What is found in either view counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import unused
from quern.session import materialise

WINDOW = 8
# An item leaks if so many of its tokens, or all of a shorter item, stand in a document.
ENOUGH = 13
# With fewer plain words than this among them, the values must be equal too.
LITERALS = 4
# Up to so many rows of 40 bytes are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
# Up to so many different pairs of tokens of a view's items decide which windows of the documents are hashed at all.
BEGINS = 50_000

UNITS = (
    "mm cm dm km m mg kg g t ml cl dl l s ms min mins h hr hrs sec secs am pm years year days day hours hour minutes minute weeks week "
    "months month miles mile meters meter metres metre inches inch feet foot ft in lb lbs oz kmh mph kwh kw w v hz ghz mhz gb mb kb tb "
    "dollars dollar cents cent euros euro pounds pound percent "
    "seconds second milliseconds millisecond decades decade centuries century "
    "millimeters millimeter millimetres millimetre centimeters centimeter centimetres centimetre decimeters decimeter decimetres decimetre "
    "kilometers kilometer kilometres kilometre yards yard yd yds acres acre hectares hectare ha "
    "milligrams milligram grams gram kilograms kilogram kilos kilo tonnes tonne tons ton ounces ounce stones stone "
    "milliliters milliliter millilitres millilitre centiliters centiliter centilitres centilitre deciliters deciliter decilitres decilitre "
    "liters liter litres litre gallons gallon gal quarts quart qt pints pint pt cups cup tablespoons tablespoon tbsp teaspoons teaspoon tsp "
    "watts watt kilowatts kilowatt volts volt amperes ampere amps amp hertz joules joule calories calorie kcal degrees degree celsius fahrenheit "
    "bytes byte bits bit kilobytes kilobyte megabytes megabyte gigabytes gigabyte terabytes terabyte knots knot "
    "pence penny yen rupees rupee francs franc pesos peso"
).split()
# Shorter ones are words too ("in", "am"), so they need a number before them.
FREE_UNIT_LETTERS = 3
FREE_UNITS = [u for u in UNITS if len(u) >= FREE_UNIT_LETTERS]
# Possessive, as the JVM's matcher recurses for each repetition of a group that it could give back, and overflows on
# long runs; what follows a run never needs a part of it.
_CAPITAL = r"\p{Ll}[\p{L}\p{M}]*+(?: \p{Lu}\p{Ll}[\p{L}\p{M}]*+)*+"
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;:] .)" + _CAPITAL
# What must follow is looked at first, as that is seldom there.
_ANY_NAME = r"(?=\p{Lu})(?<![\p{L}\p{M}])\p{Lu}" + _CAPITAL
_NUMBER = r"\p{Nd}++(?:[.,:/]\p{Nd}++)*+"
# A part of a longer number is never tried anew, which would take the square of its length.
_WHOLE_NUMBER = rf"(?=\p{{Nd}})(?<!\p{{Nd}}|\p{{Nd}}[.,:/]){_NUMBER}"
_SIGNS = "%€$£°"
_UNIT = rf"(?:(?i:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{M}}])|[{_SIGNS}])"
# In lower case only, so that it is never found inside a name.
_FREE_UNIT = (
    rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(sorted(FREE_UNITS, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{M}}])"
)
# Letters, or numbers, or a sign after a number: what both templates' tokens consist of.
_ATOM = rf"[\p{{L}}\p{{M}}]++|{_NUMBER}|(?=[{_SIGNS}])(?<=\p{{Nd}}|\p{{Nd}} )[{_SIGNS}]"
# Private characters: number, name and unit; begin and end of a value.
NUMBER, NAME, UNIT, OPEN, CLOSE = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
_BLANK = "     "
STRICT, LOOSE, PLAIN = "strict", "loose", "plain"
VIEWS = (STRICT, LOOSE, PLAIN)


def _template(text: Column, view: str) -> Column:
    """The text with placeholders, of the same tokens in the same order as ``_valued``."""
    text = F.regexp_replace(F.translate(text, NUMBER + NAME + UNIT + OPEN + CLOSE, _BLANK), _ANY_NAME if view == LOOSE else _NAME, f" {NAME} ")
    text = F.regexp_replace(text, f"({_WHOLE_NUMBER})( ?)({_UNIT})", f" {NUMBER} {UNIT} ")
    text = F.regexp_replace(text, _NUMBER, f" {NUMBER} ")
    return text


def _valued(text: Column, view: str) -> Column:
    """The text with every placeholder's value between marks."""
    names = _ANY_NAME if view == LOOSE else _NAME
    text = F.regexp_replace(F.translate(text, NUMBER + NAME + UNIT + OPEN + CLOSE, _BLANK), names, f" {OPEN}p$0{CLOSE} ")
    text = F.regexp_replace(text, f"({_WHOLE_NUMBER})( ?)({_UNIT})", f" {OPEN}n$1{CLOSE} {OPEN}u$3{CLOSE} ")
    text = F.regexp_replace(text, rf"(?<!{OPEN}n|\p{{Nd}}|\p{{Nd}}[.,:/]){_NUMBER}", f" {OPEN}n$0{CLOSE} ")
    return F.lower(F.regexp_replace(text, _FREE_UNIT, f" {OPEN}u$0{CLOSE} ") if view == LOOSE else text)


def template_tokens(text: Column, view: str = STRICT) -> Column:
    text = F.coalesce(text, F.lit(""))
    if view == PLAIN:
        text = F.lower(F.translate(text, NUMBER + NAME + UNIT + OPEN + CLOSE, _BLANK))
        return F.regexp_extract_all(text, F.lit(_ATOM), F.lit(0))
    gaps = rf"[^\p{{L}}\p{{M}}{NUMBER}{NAME}{UNIT}]+"
    if view == STRICT:
        return F.array_remove(F.split(F.lower(_template(text, view)), gaps), "")
    tokens = F.array_remove(F.split(_template(text, view), gaps), "")
    # A unit in lower case only, so that it is none that begins a name; by token, as a pattern of all units is slow.
    return F.transform(tokens, lambda t: F.when(t.isin(FREE_UNITS), F.lit(UNIT)).otherwise(F.lower(t)))


def valued_tokens(text: Column, view: str = STRICT) -> Column:
    if view == PLAIN:
        return template_tokens(text, view)
    return F.regexp_extract_all(_valued(F.coalesce(text, F.lit("")), view), F.lit(rf"{OPEN}[^{CLOSE}]*{CLOSE}|[\p{{L}}\p{{M}}]+"), F.lit(0))


def _owners(values: Column) -> Column:
    """For each word or number of a text the place of the token that holds it; a name can hold several."""
    holds = lambda v: F.when(v.startswith(OPEN + "p"), F.size(F.split(v, " "))).otherwise(1)
    return F.flatten(F.transform(values, lambda v, i: F.array_repeat(i, holds(v))))


def _begin(tokens: str | Column, start: Column) -> Column:
    """Hash of the two tokens at ``start``, counted from 1; of one where the text ends."""
    return F.xxhash64(F.get(tokens, start - 1), F.get(tokens, start))


def _begins(tokens: Column) -> Column:
    """Hashes of two tokens at all places of an item, or of its only one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1)))
    return F.transform(F.when(F.size(tokens) > 0, starts), lambda i: _begin(tokens, i))


def _begun(widths: list[int], begins: list[int] | None) -> Column:
    """Whether the ``tokens`` at ``start`` begin like those of an item's window; true where that is not known."""
    if begins is None:
        return F.lit(True)
    # As text, since thousands of literals are slow to build one by one.
    listed = ", ".join(f"{b}L" if b > -(1 << 63) else "cast('-9223372036854775808' as long)" for b in begins or [0])
    found = F.expr(f"xxhash64(get(tokens, start - 1), get(tokens, start)) in ({listed})")
    return found | F.expr(f"xxhash64(get(tokens, start - 1)) in ({listed})") if 1 in widths else found


def _windows(tokens: Column, width: Column | int) -> Column:
    """Hashes of all windows of ``width`` tokens, in order; empty where there are fewer tokens."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, width)))
    return F.when(F.size(tokens) >= width, hashes)


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be sent to all tasks if it is small enough; ``df`` must be cheap to count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"
    )


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def _matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, item_hash, view, shift, starts, width): windows in common, by alignment.

    Items shorter than a window are looked for in windows of their own length.
    """
    known = None
    for view in VIEWS:
        own = items.select("item_id", "item_hash", F.lit(view).alias("view"), F.col(f"{view}_tokens").alias("tokens"))
        own = own.withColumn("width", F.least(F.size("tokens"), F.lit(WINDOW))).where("width > 0")
        own = own.select("item_id", "item_hash", "view", "width", F.posexplode_outer(_windows(F.col("tokens"), F.col("width"))).alias("start", "hash"))
        known = own if known is None else known.unionByName(own)
    known = materialise(known, "item-windows")
    sizes = known.select("view", "width").distinct().collect()
    tokens = _keyed(docs).select("doc_id", "text_hash", *(template_tokens(F.col("text"), view).alias(view) for view in VIEWS))
    views = [F.struct(F.lit(v).alias("view"), F.col(v).alias("tokens")) for v in VIEWS]
    rows = tokens.select("doc_id", "text_hash", F.inline_outer(F.array(*views)))
    # A row for each place, as rows are compiled and functions over arrays are not. An inner explode would get a filter
    # on its array.
    rows = rows.select("*", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("tokens"), F.lit(1)))).alias("start"))
    begun, widths = F.lit(False), F.array().cast("array<int>")
    for view in VIEWS:
        own = sorted(r["width"] for r in sizes if r["view"] == view)
        if own:
            found = items.select(F.explode(_begins(F.col(f"{view}_tokens"))).alias("b")).distinct().limit(BEGINS + 1).collect()
            # Beyond the limit all windows are joined.
            begun |= (F.col("view") == view) & _begun(own, [r["b"] for r in found] if len(found) <= BEGINS else None)
            widths = F.when(F.col("view") == view, F.array(*map(F.lit, own))).otherwise(widths)
    rows = rows.where(begun).select("*", F.explode_outer(widths).alias("width")).where("start <= size(tokens) - width + 1")
    hashed = F.xxhash64(F.slice("tokens", F.col("start"), F.col("width")))
    rows = rows.select("doc_id", "text_hash", "view", "width", (F.col("start") - 1).alias("at"), hashed.alias("hash"))
    rows = rows.join(_small(known), ["hash", "view", "width"])
    found = rows.groupBy("doc_id", "text_hash", "item_id", "item_hash", "view", "width", (F.col("at") - F.col("start")).alias("shift")).agg(
        F.collect_set("start").alias("starts")
    )
    return materialise(found, "item-hits")


def _tokens_of(starts: str) -> Column:
    """The places of the tokens in windows that begin at ``starts``, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.col("width") - 1)))))


def _copied(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Alignments of the plain view: (..., found, n_slots, n_changed), found being places of words and numbers.

    Numbers alone, or with few words, do not tell an item unless it is whole.
    """
    rows = hits.join(items.select("item_id", "item_hash", F.col("plain_tokens").alias("tokens")), ["item_id", "item_hash"])
    rows = rows.withColumn("found", _tokens_of("starts"))
    words = F.filter("found", lambda p: F.get("tokens", p).rlike(r"^[\p{L}\p{M}]"))
    told = (F.size(words) >= LITERALS) | (F.size("found") == F.size("tokens"))
    return rows.select("doc_id", "text_hash", "item_id", "item_hash", "view", F.when(told, F.col("found")).alias("found"), F.lit(0).alias("n_slots"), F.lit(0).alias("n_changed"))


def _fitting(docs: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """Alignments of the views with placeholders, without the windows whose slots do not fit: as ``_copied``.

    No filter stands between the steps, as it would repeat all steps before it.
    """
    wanted = _small(hits.select("doc_id", "text_hash").distinct())
    keyed = _keyed(docs)
    texts = keyed.join(wanted, _same_row(keyed, wanted), "left_semi")
    views = [F.struct(F.lit(v).alias("view"), valued_tokens(F.col("text"), v).alias("doc_values")) for v in (STRICT, LOOSE)]
    texts = texts.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.inline_outer(F.array(*views)))
    views = [F.struct(F.lit(v).alias("view"), F.col(f"{v}_values").alias("item_values"), F.col(f"{v}_owners").alias("owners")) for v in (STRICT, LOOSE)]
    known = items.select("item_id", "item_hash", "n_item_tokens", F.inline_outer(F.array(*views)))
    rows = hits.join(texts, _same_row(hits, texts) & (hits["view"] == texts["view"])).drop(texts["doc_id"]).drop(texts["text_hash"]).drop(texts["view"])
    rows = rows.join(known, ["item_id", "item_hash", "view"])
    paired = lambda places: F.transform(
        places,
        lambda p: F.struct(
            p.alias("at"), F.get("item_values", p).alias("ours"), F.get("doc_values", p + F.col("shift")).alias("theirs")
        ),
    )
    slots = F.filter(paired(_tokens_of("starts")), lambda p: p["ours"].startswith(OPEN))
    rows = rows.withColumn("slots", slots)
    word = lambda v: v.substr(F.lit(3), F.length(v) - 3)
    named = F.filter("slots", lambda p: (F.col("view") == LOOSE) & p["ours"].startswith(OPEN + "p"))
    for side in ("ours", "theirs"):
        rows = rows.withColumn(f"{side}_names", F.array_sort(F.array_distinct(F.transform(named, lambda p: F.struct(F.length(p[side]).alias("n"), word(p[side]).alias("name"))))))  # noqa: B023

    def known_as(p: Column, side: str) -> Column:
        """A run that begins a sentence can hold a word before the name ("So Olga"): the shortest name that ends it."""
        ends = F.filter(f"{side}_names", lambda x: F.concat(F.lit(" "), word(p[side])).endswith(F.concat(F.lit(" "), x["name"])))
        name = F.concat(F.substring(p[side], 1, 2), F.get(ends, F.lit(0))["name"], F.lit(CLOSE))
        return F.when(p["ours"].startswith(OPEN + "p"), F.coalesce(name, p[side])).otherwise(p[side])

    fields = lambda p: F.struct(*(p[c].alias(c) for c in ("at", "ours", "theirs")), known_as(p, "ours").alias("a"), known_as(p, "theirs").alias("b"))
    rows = rows.withColumn("slots", F.transform("slots", fields))
    mapped = F.array_distinct(F.transform("slots", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))
    # Numbers that are equal in the item by chance differ when it is filled in anew.
    rows = rows.withColumn("mapped", F.filter(mapped, lambda m: ~m["a"].startswith(OPEN + "n")))
    rows = rows.withColumn("ours", F.transform("mapped", lambda m: m["a"]))
    rows = rows.withColumn("theirs", F.transform(F.filter("mapped", lambda m: m["a"].startswith(OPEN + "p")), lambda m: m["b"]))
    twice = lambda c: F.array_distinct(F.filter(c, lambda x: F.size(F.filter(c, lambda y: y == x)) > 1))
    rows = rows.withColumn("ours", twice("ours")).withColumn("theirs", twice("theirs"))

    def misfit(p: Column) -> Column:
        kind = ~F.substring(p["ours"], 1, 2).eqNullSafe(F.substring(p["theirs"], 1, 2))
        named = p["ours"].startswith(OPEN + "p") & F.array_contains("theirs", p["b"])
        unfit = kind | F.array_contains("ours", p["a"]) | named
        # A word that also stands in lower case begins a sentence, and in so few words it tells the item.
        plain = lambda v: F.array_contains("item_values", word(v)) | F.array_contains("doc_values", word(v))
        short = (F.col("view") == LOOSE) & (F.col("n_item_tokens") < ENOUGH) & p["ours"].startswith(OPEN + "p") & (p["ours"] != p["theirs"])
        return unfit | (short & (plain(p["ours"]) | plain(p["theirs"])))

    changed = lambda p: ~p["ours"].eqNullSafe(p["theirs"])
    rows = rows.withColumn("unfit", F.transform(F.filter("slots", misfit), lambda p: p["at"]))
    rows = rows.withColumn("changed", F.transform(F.filter("slots", changed), lambda p: p["at"]))
    holds = lambda places, s: F.exists(places, lambda p: p.between(s, s + F.col("width") - 1))
    kept = F.filter("starts", lambda s: ~holds("unfit", s) | ~holds("changed", s))
    rows = rows.withColumn("starts", kept).withColumn("covered", _tokens_of("starts"))
    rows = rows.withColumn("slots", F.array_intersect("covered", F.transform("slots", lambda p: p["at"])))
    rows = rows.withColumn("changed", F.array_intersect("covered", "changed"))
    told = (F.size("starts") > 0) & ((F.size("covered") - F.size("slots") >= LITERALS) | (F.size("changed") == 0))
    first = F.transform("covered", lambda p: F.array_position("owners", p) - 1)
    length = lambda p: F.when(F.get("item_values", p).startswith(OPEN + "p"), F.size(F.split(F.get("item_values", p), " "))).otherwise(1)
    found = F.flatten(F.zip_with(first, "covered", lambda i, p: F.sequence(i, i + length(p) - 1)))
    found = F.transform(found, lambda i: i.cast("int"))
    counts = [F.when(told, F.size(c)).otherwise(0).alias(f"n_{c}") for c in ("slots", "changed")]
    return rows.select("doc_id", "text_hash", "item_id", "item_hash", "view", F.when(told, found).alias("found"), *counts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that stands in it: doc_id, text_hash, item_id, n_tokens,
    n_item_tokens, n_slots, n_changed.

    ``n_tokens`` counts the item's tokens found on consistent alignments of the first view where these are enough, and
    else those found in any view; ``n_slots`` counts the placeholders on one alignment and ``n_changed`` those with another value than in the item, at most. Null, empty and wordless texts
    have no rows; repeated rows of ``docs`` give one. Items are held by item_id; of repeated ids all texts count.
    """
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("item_hash"), F.col("text").alias("item_text")
    ).distinct()
    text = F.col("item_text")
    for view in VIEWS:
        items = items.withColumn(f"{view}_tokens", template_tokens(text, view))
        if view != PLAIN:
            items = items.withColumn(f"{view}_values", valued_tokens(text, view))
            items = items.withColumn(f"{view}_owners", _owners(F.col(f"{view}_values")))
    items = items.withColumn("n_item_tokens", F.size(f"{STRICT}_tokens")).drop("item_text")
    items = materialise(items.where("n_item_tokens > 0"), "items")
    hits = _matches(docs, items)
    placed = hits.where(hits["view"] != PLAIN)
    rows = _copied(hits.where(hits["view"] == PLAIN), items).unionByName(_fitting(docs, placed, items))
    by_item = rows.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(
        F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("view") == STRICT, F.col("found"))))).alias("found_strict"),
        F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed")
    )
    by_item = by_item.join(items.select("item_id", "item_hash", "n_item_tokens", F.col(f"{STRICT}_owners").alias("owners")), ["item_id", "item_hash"])
    # A token is found with all its words.
    missing = lambda c: F.array_except(F.sequence(F.lit(0), F.size("owners") - 1), c)
    tokens = lambda c: F.col("n_item_tokens") - F.size(F.array_distinct(F.transform(missing(c), lambda i: F.get("owners", i))))
    enough = F.least(F.lit(ENOUGH), F.col("n_item_tokens"))
    by_item = by_item.withColumn("n_strict", tokens("found_strict")).withColumn("n_all", tokens("found"))
    by_item = by_item.withColumn("n_tokens", F.when(F.col("n_strict") >= enough, F.col("n_strict")).otherwise(F.col("n_all")))
    by_item = by_item.where(F.col("n_tokens") >= enough)
    best = F.max_by(F.struct("n_tokens", "n_item_tokens", "n_slots", "n_changed"), F.struct("n_tokens", "item_hash"))
    return by_item.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select("doc_id", "text_hash", "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item stands."""
    found = materialise(leaks(docs, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    names = [unused(docs, c) for c in ("leak_of", "leak_by")]
    bad = _small(found.select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])))
    hashed = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad[names[0]]) & (hashed == bad[names[1]]), "left_anti")
