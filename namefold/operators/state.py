"""Fold of ordered asset events into one current record per name.

An event row is one asset of one surviving output, or one burned asset:

``name, policy, label, hex, owner_hex, kind, slot, rank, tx_pos, idx, utxo,
address, holder, lovelace, script, datum, is_mint, datum_holder``

``kind`` is ``burn``, ``label_burn``, ``owner``, ``virtual``, ``settings``,
``reference`` or ``other``; ``datum`` is the decoded datum as JSON text and
``datum_holder`` the holder of the address in it. Rows
are ordered per name by ``ORDER``: burns of a block come first, then label
burns, then outputs with a 222 token, then the rest.

Only the copy counter needs the order of all rows: it says where a record ended.
Every field is then the newest (or oldest) value after that point. Rows are
shuffled by name once, and one sorted pass counts and picks the fields. Names
with more than ``HOT_ROWS`` rows are counted by ranges of slots instead
(`scan.with_counter`), so no task gets a hot name whole.

A mint counts as a second copy if the name's last owner token has the same
identity, its stored output is another one, and the record was not burned away since. The identity a record took
from a settings or reference token alone does not count; that differs only for
names that mix virtual and owner tokens, which the ledger rules out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namefold.functions import assets, attributes
from namefold.functions.assets import REGISTRY_LABELS
from namefold.operators import scan
from namefold.scratch import materialize

ORDER = ("slot", "rank", "tx_pos", "idx", "hex")
SLOT_CHUNK = 50_000
HOT_ROWS = 200_000  # a name with more rows is spread over ranges of slots
BURNS = ("burn", "label_burn")

EVENT_SCHEMA = (
    "name STRING, policy STRING, label STRING, hex STRING, owner_hex STRING, kind STRING, slot BIGINT, rank INT,"
    " tx_pos BIGINT, idx INT, utxo STRING, address STRING, holder STRING, lovelace DECIMAL(38,0),"
    " script STRUCT<type: STRING, cbor: STRING>, datum STRING, is_mint BOOLEAN, datum_holder STRING"
)
_EVENT_COLUMNS = ("name", "policy", "label", "hex", "owner_hex", "kind", *ORDER[:-1], "utxo", "address", "holder", "lovelace", "script",
                  "datum", "is_mint", "datum_holder")


class MissingMintError(ValueError):
    """An output holds a name that was never minted."""


def event_kind(label: Column) -> Column:
    """Kind of an asset held by an output."""
    return (
        F.when(label.isNull() | (label == assets.LABEL_OWNER), "owner")
        .when(label == assets.LABEL_VIRTUAL, "virtual")
        .when(label == assets.LABEL_SETTINGS, "settings")
        .when(label == assets.LABEL_REFERENCE, "reference")
        .otherwise("other")
    )


def net_of_block(outputs: DataFrame, inputs: DataFrame, *, utxo: str = "utxo", slot: str = "slot") -> DataFrame:
    """Outputs that are not spent in the block that made them."""
    spent = inputs.select(utxo, slot).distinct()
    return outputs.join(spent, [utxo, slot], "left_anti")


def live_outputs(outputs: DataFrame, inputs: DataFrame, *, utxo: str = "utxo") -> DataFrame:
    """Outputs that no input ever spends."""
    return outputs.join(inputs.select(utxo).distinct(), utxo, "left_anti")


def current_owner(events: DataFrame, keys: list[str], order: list[str], burned: Column, payload: list[str]) -> DataFrame:
    """Newest event per key, dropped where it is a burn. The short form of the fold
    for feeds in which every event moves the whole asset."""
    newest = events.groupBy(*keys).agg(
        F.max_by(F.struct(*payload, burned.alias("__burned")), F.struct(*order)).alias("__newest")
    )
    return newest.filter(~F.col("__newest")["__burned"]).select(*keys, *[F.col("__newest")[c].alias(c) for c in payload])


def mint_history(events: DataFrame) -> DataFrame:
    """Replay-safe mint records; ``events`` are mints with ``label, name, slot, tx_hash, metadata``."""
    return (
        events.filter(assets.counts_as_mint(F.col("label")) & (F.col("name") != ""))
        .select("name", F.col("slot").alias("created_slot"), "tx_hash", "metadata")
        .distinct()
    )


def first_mint(mints: DataFrame) -> DataFrame:
    return mints.groupBy("name").agg(
        F.min_by(F.struct("created_slot", "tx_hash", "metadata"), F.struct("created_slot", "tx_hash")).alias("m")
    ).select("name", "m.*")


def missing_mints(outputs: DataFrame, mints: DataFrame) -> DataFrame:
    """Names held by outputs without any mint record; must be empty."""
    return outputs.select("name").distinct().join(mints.select("name").distinct(), "name", "left_anti")


def prepare(events: DataFrame) -> DataFrame:
    """Rows that change a record: no reference token without datum, no nameless
    token, one main burn per name and block. Land the result: the fold reads it
    several times."""
    skip = (F.col("kind") == "reference") & F.col("datum").isNull()
    kept = events.filter(~skip & (F.col("name") != ""))
    is_burn = F.col("kind") == "burn"
    position = ("rank", "tx_pos", "idx", "hex")
    burns = kept.filter(is_burn).groupBy("name", "slot").agg(*[F.min(c).alias(c) for c in position])
    columns = [
        F.lit("burn").alias("kind") if c == "kind"
        else F.col(c) if c in burns.columns
        else F.lit(None).cast(events.schema[c].dataType).alias(c)
        for c in events.columns
    ]
    return kept.filter(~is_burn).unionByName(burns.select(*columns))


def _is_mint() -> Column:
    return (F.col("kind") == "owner") & F.coalesce(F.col("is_mint"), F.lit(False))


def _is_double() -> Column:
    """A mint of the identity that the last owner token has, in another output. Two
    assets of one output, or a mint applied again, are no second copy."""
    return F.coalesce(_is_mint() & (F.col("previous_hex") == F.col("owner_hex")) & (F.col("previous_utxo") != F.col("utxo")), F.lit(False))


def _steps(count_double_mints: bool) -> tuple[Column, Column]:
    """What a row adds to the copies of its name, and the least number after it."""
    kind = F.col("kind")
    double = _is_double() if count_double_mints else F.lit(False)
    add = F.when(kind == "burn", -1).when(double, 1).otherwise(0)
    floor = (
        F.when(kind == "burn", 0)
        .when(kind == "state", F.col("held"))
        .when(kind.isin("owner", "virtual") & ~double, 1)
    )
    return add, floor


def _seen_hex() -> Column:
    return F.when(F.col("kind").isin("owner", "state"), F.col("owner_hex"))


def _seen_utxo() -> Column:
    return F.when(F.col("kind").isin("owner", "virtual", "state"), F.col("utxo"))


def _start(prior: DataFrame) -> DataFrame:
    """Stored records as the rows their names begin with."""
    return prior.select(
        "name", F.lit(-1).cast("bigint").alias("slot"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("tx_pos"),
        F.lit(0).alias("idx"), F.lit("").alias("hex"), F.lit("state").alias("kind"), F.col("hex").alias("owner_hex"),
        "utxo", F.lit(False).alias("is_mint"),
        F.when(F.col("utxo") != "", F.col("amount")).otherwise(0).cast("bigint").alias("held"),
    )


def copy_counter(events: DataFrame, prior: DataFrame | None = None, *, count_double_mints: bool = True,
                 width: int = SLOT_CHUNK) -> DataFrame:
    """Prepared events with ``previous_hex`` and the number of ``copies`` after each, counted by ranges of slots.

    Only names that burn or mint again are counted; all others stay at one copy.
    A record without an owner token yet counts 0 copies.
    """
    mint = _is_mint()
    first_owner = F.min(F.when(F.col("kind") == "owner", F.struct(*ORDER)))
    per_name = events.groupBy("name").agg(
        F.count_if(F.col("kind") == "burn").alias("burns"), F.count_if(mint).alias("mints"),
        (first_owner == F.min(F.when(mint, F.struct(*ORDER)))).alias("minted_first"),
    )
    once = (F.col("mints") == 0) | ((F.col("mints") == 1) & F.col("minted_first"))
    if prior is not None:
        once = F.col("mints") == 0
    busy = per_name.filter((F.col("burns") > 0) | ~once).select("name")
    rows = events.select(
        "name", *ORDER, "kind", "owner_hex", "utxo", "is_mint", F.lit(None).cast("bigint").alias("held")
    ).join(busy, "name", "left_semi")
    if prior is not None:
        rows = rows.unionByName(_start(prior).join(busy, "name", "left_semi"))
    # The scans below read these narrow rows four times; landing them is cheaper
    # than repeating the joins above.
    rows = materialize(scan.with_chunk(rows, "slot", width), "busy")
    rows = scan.with_last_seen(rows, ["name"], ORDER, _seen_hex(), "previous_hex")
    rows = scan.with_last_seen(rows, ["name"], ORDER, _seen_utxo(), "previous_utxo")
    return scan.with_counter(rows, ["name"], ORDER, *_steps(count_double_mints), "copies")


def _counted_in_order(rows: DataFrame, prior: DataFrame | None, count_double_mints: bool) -> DataFrame:
    """What `copy_counter` adds, for names that one task can hold: one shuffle and one sort by name.

    ``n`` is the place of a row within its name (equal positions share one);
    ``copies`` is null for names that need no counting.
    """
    rows = rows.withColumn("held", F.lit(None).cast("bigint"))
    if prior is not None:
        rows = rows.unionByName(_start(prior), allowMissingColumns=True)
    along = Window.partitionBy("name").orderBy(*ORDER)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("name")
    rows = rows.select(
        "*", F.rank().over(along).alias("n"), F.last(_seen_hex(), ignorenulls=True).over(before).alias("previous_hex"),
        F.last(_seen_utxo(), ignorenulls=True).over(before).alias("previous_utxo"))
    add, floor = _steps(count_double_mints)
    rows = rows.select("*", F.sum(add).over(upto).alias("__sum"), floor.alias("__floor"))
    mint = _is_mint()
    rows = rows.select(
        "*", F.max(F.col("__floor") - F.col("__sum")).over(upto).alias("__lift"), F.count_if(F.col("kind") == "burn").over(whole).alias("__burns"),
        F.count_if(mint).over(whole).alias("__mints"), F.min(F.when(F.col("kind") == "owner", F.col("n"))).over(whole).alias("__first"),
        F.min(F.when(mint, F.col("n"))).over(whole).alias("__minted"))
    once = F.col("__mints") == 0
    if prior is None:
        once = once | ((F.col("__mints") == 1) & (F.col("__first") == F.col("__minted")))
    copies = (F.col("__sum") + F.greatest(F.lit(0), "__lift")).cast("bigint")
    return rows.withColumn("copies", F.when((F.col("__burns") > 0) | ~once, copies)).drop(
        "held", "__sum", "__floor", "__lift", "__burns", "__mints", "__first", "__minted")


def _by_size(events: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Events of names that one task can hold, and those of hot names, if there are any."""
    hot = scan.frequent(events, "name", HOT_ROWS)
    if not hot:
        return events, None
    return events.filter(~F.col("name").isin(hot)), events.filter(F.col("name").isin(hot))


def double_mints(events: DataFrame, *, width: int = SLOT_CHUNK) -> DataFrame:
    """Mints of a name that still has a copy under the same identity."""
    events, hot = _by_size(events.select("name", *ORDER, "kind", "owner_hex", "utxo", "is_mint"))
    columns = ["name", "slot", "utxo", "kind", "is_mint", "owner_hex", "previous_hex", "previous_utxo", "copies"]
    counted = _counted_in_order(events, None, True).select(*columns)
    if hot is not None:
        counted = counted.unionByName(copy_counter(hot, width=width).select(*columns))
    return counted.filter(_is_double() & (F.col("copies") > 1)).select("name", "slot", "utxo", F.col("copies").alias("amount"))


def _drop_late(events: DataFrame, prior: DataFrame) -> DataFrame:
    """An older slot never overwrites a stored record; its label still counts."""
    known = prior.select("name", F.col("updated_slot_number").alias("__updated"), F.col("utxo").alias("__utxo"))
    late = (F.col("slot") < F.col("__updated")) & ~F.col("kind").isin(*BURNS)
    late = late & ~((F.col("kind") == "owner") & (F.col("__utxo") == ""))
    joined = events.join(known, "name", "left")
    kind = F.when(F.coalesce(late, F.lit(False)), F.lit("other")).otherwise(F.col("kind"))
    return joined.withColumn("kind", kind).drop("__updated", "__utxo")


def label_sets(rows: DataFrame, key: str, label: str, tracked: tuple[str, ...] = REGISTRY_LABELS, separator: str = "") -> DataFrame:
    """Sorted distinct tracked labels per key. The labels are a fixed few, so each
    is one flag of the aggregate and no set is collected."""
    flags = [F.max(F.when(F.col(label) == value, F.lit(value))).alias(f"l{i}") for i, value in enumerate(sorted(tracked))]
    grouped = rows.groupBy(key).agg(*flags)
    return grouped.select(key, F.concat_ws(separator, *[f"l{i}" for i in range(len(tracked))]).alias("labels"))


def _outcomes(counted: DataFrame) -> DataFrame:
    """Copies left per counted name, and the order key of the burn that last ended its record."""
    position = F.struct(*ORDER)
    ended = (F.col("kind") == "burn") & (F.col("copies") == 0)
    return counted.groupBy("name").agg(F.max(F.when(ended, position)).alias("cut"), F.max_by("copies", position).alias("copies"))


def _partial(events: DataFrame, outcomes: DataFrame, width: int) -> DataFrame:
    """Per name: copies left, whether the record ended, and the fields set since."""
    position = F.struct(*ORDER)
    events = scan.with_chunk(events, "slot", width)
    # Spread the cut over the name's chunks, so that no join task gets a whole hot name.
    cuts = outcomes.filter(F.col("cut").isNotNull()).select("name", "cut")
    cuts = events.select("name", scan.CHUNK).distinct().join(cuts, "name")
    rows = events.join(cuts, ["name", scan.CHUNK], "left")
    # Rows before the cut stay as empty rows, so that every touched name keeps its line.
    dead = F.coalesce(position <= F.col("cut"), F.lit(False))
    rows = rows.withColumn("kind", F.when(~dead, F.col("kind"))).drop("cut", scan.CHUNK)
    fields = _parsed(rows.groupBy("name").agg(*_fields(position)))
    ends = outcomes.select("name", "copies", F.col("cut").isNotNull().alias("ended"))
    return fields.join(ends, "name", "left").withColumn("ended", F.coalesce("ended", F.lit(False)))


def _partial_in_order(events: DataFrame, prior: DataFrame | None, count_double_mints: bool) -> DataFrame:
    """What `_partial` gives, for names that one task can hold: their rows are shuffled and sorted once."""
    # Only owner tokens set these; nothing else of them needs to travel.
    owner = F.col("kind") == "owner"
    rows = events.withColumns({c: F.when(owner, F.col(c)) for c in ("lovelace", "script")})
    rows = _counted_in_order(rows, prior, count_double_mints)
    ended = (F.col("kind") == "burn") & (F.col("copies") == 0)
    rows = rows.withColumn("cut", F.max(F.when(ended, F.col("n"))).over(Window.partitionBy("name")))
    # Rows before the cut stay as empty rows, so that every touched name keeps its line.
    stored = F.col("kind") == "state"
    dead = F.coalesce(F.col("n") <= F.col("cut"), F.lit(False)) | stored
    rows = rows.withColumn("stored", stored).withColumn("kind", F.when(~dead, F.col("kind")))
    fields = rows.groupBy("name").agg(
        *_fields(F.col("n")), F.max_by("copies", "n").alias("copies"), F.max(F.col("cut").isNotNull()).alias("ended"),
        F.bool_and("stored").alias("untouched"))
    return _parsed(fields.filter(~F.col("untouched")).drop("untouched"))


def _fields(position: Column) -> list[Column]:
    """The newest values of a name's rows; rows without a kind set nothing. Datums are parsed afterwards, one or few per name (`_parsed`)."""
    kind = F.col("kind")
    has_datum = F.col("datum").isNotNull()
    attrs_set = F.when(kind.isin("reference", "virtual"), attributes.is_attributes(F.col("datum")))

    def newest(value: Column, condition: Column, name: str) -> Column:
        return F.max_by(value, F.when(condition, position)).alias(name)

    owner = kind == "owner"
    output = ~kind.isin(*BURNS)  # null, hence no, for rows before the cut
    places = F.struct(F.coalesce("address", F.lit("")).alias("address"), F.coalesce("holder", F.lit("")).alias("holder"))
    return [
        F.min_by(F.struct("policy", "owner_hex", "slot", "kind", places.alias("place")), F.when(output, position)).alias("first"),
        newest(F.struct("owner_hex", "lovelace", "script", "datum"), owner, "owned"),
        newest(F.col("utxo"), kind.isin("owner", "virtual"), "utxo"),
        newest(F.struct("kind", places.alias("place"), F.when(~owner, F.col("datum")).alias("datum"), "datum_holder"),
               owner | ((kind == "virtual") & attrs_set), "place"),
        newest(F.col("datum"), attrs_set, "attrs"),
        newest(F.col("utxo"), kind.isin("reference", "virtual"), "reference_utxo"),
        newest(F.struct("datum", "utxo"), (kind == "settings") & has_datum, "settings"),
        newest(F.struct(F.when(attrs_set, F.col("datum")).alias("datum")), output, "default"),
        F.max(F.when(kind.isin("owner", "virtual") | ((kind == "settings") & has_datum), F.col("slot"))).alias("updated"),
        F.max(F.when(kind == "virtual", True)).alias("is_virtual"),
        *[
            newest(kind != "label_burn", (F.col("label") == label) & (kind != "burn"), f"label_{label}")
            for label in REGISTRY_LABELS
        ],
    ]


def _parsed(fields: DataFrame) -> DataFrame:
    """Aggregated `_fields` with their datums read."""
    place = F.col("place")
    # The datum of a virtual token says where it belongs, whoever holds the output.
    address = F.try_element_at(attributes.datum_attributes(place["datum"])["resolved_addresses"], F.lit("ada"))
    told = F.struct(
        F.coalesce(F.regexp_replace(address, "^0x", ""), F.lit("")).alias("address"),
        F.coalesce(place["datum_holder"], F.lit("")).alias("holder"),
    )
    default = F.coalesce(attributes.datum_attributes(F.col("default.datum"))["default"], F.lit(False))
    settings = F.struct(attributes.settings_struct(F.col("settings.datum")).alias("settings"), F.col("settings.utxo").alias("utxo_id"))
    return fields.withColumns({
        "place": F.when(place["kind"] == "owner", place["place"]).when(place.isNotNull(), told),
        "attrs": attributes.datum_attributes(F.col("attrs")),
        "default": F.when(F.col("default").isNotNull(), default),
        "settings": F.when(F.col("settings").isNotNull(), settings),
    })


def fold(events: DataFrame, mints: DataFrame, prior: DataFrame | None = None, *, og_list: DataFrame | None = None,
         count_double_mints: bool = True, width: int = SLOT_CHUNK, strict: bool = True) -> DataFrame:
    """Current records of every name touched by prepared ``events``.

    With ``prior`` (an earlier result) the events continue from it and the result
    holds the touched names only, with ``exists = false`` where a record ended.
    Without it the result holds the existing records. ``og_list`` (``name,
    og_number``) numbers the names whose datum has not set a number. A name held
    by an output must have a mint record, else `MissingMintError` is raised;
    without ``strict`` its first slot stands in.
    """
    minted = materialize(first_mint(mints).select("name", F.col("created_slot").alias("minted")), "minted")
    if strict:
        unknown = missing_mints(events.filter(~F.col("kind").isin(*BURNS)), minted).limit(5).collect()
        if unknown:
            raise MissingMintError(f"no mint record for {', '.join(sorted(r['name'] for r in unknown))}")
    columns = [c for c in events.columns if c in _EVENT_COLUMNS]
    few, hot = _by_size(events.select(*columns))
    late = lambda rows: rows if prior is None else _drop_late(rows, prior)
    part = _partial_in_order(late(few), prior, count_double_mints)
    if hot is not None:
        rows = late(hot)
        counted = copy_counter(rows, prior, count_double_mints=count_double_mints, width=width)
        part = part.unionByName(_partial(rows, materialize(_outcomes(counted), "outcomes"), width))
    old = None
    if prior is not None:
        old = prior.select("name", F.struct(*[c for c in prior.columns if c != "name"]).alias("old"))
        part = part.join(old, "name", "left").withColumn("old", F.when(~F.col("ended"), F.col("old")))
    part = part.join(minted, "name", "left")
    if og_list is None:
        part = part.withColumn("listed_og", F.lit(0))
    else:
        part = part.join(og_list.select("name", F.col("og_number").alias("listed_og")), "name", "left")
    records = _records(part, old is not None)
    if prior is not None:
        return records
    return records.filter("exists").drop("exists")


def _records(part: DataFrame, has_old: bool) -> DataFrame:
    name = F.col("name")

    def kept(new: Column, field: str) -> Column:
        return F.coalesce(new, F.col("old")[field]) if has_old else new

    def owned(field: str) -> Column:
        if not has_old:
            return F.col("owned")[field]
        return F.when(F.col("owned").isNotNull(), F.col("owned")[field]).otherwise(F.col("old")[field])

    first = F.col("first")
    # The first event of a record fixes what no later event sets: a reference
    # token knows no address, other tokens leave their own.
    first_place = F.when(first["kind"] == "reference", F.lit("")).otherwise(first["place"]["address"])
    first_holder = F.when(first["kind"] == "reference", F.lit("")).otherwise(first["place"]["holder"])
    attrs = F.col("attrs")
    old = (lambda field: F.col("old")[field]) if has_old else (lambda field: F.lit(None))
    address = F.coalesce(F.col("place")["address"], old("address"), first_place)
    extra = F.coalesce(
        F.map_filter(attrs["resolved_addresses"], lambda k, v: k != "ada"),
        *([F.map_filter(old("resolved_addresses"), lambda k, v: k != "ada")] if has_old else []),
        F.create_map().cast("map<string,string>"),
    )
    labels = [
        F.when(kept(F.col(f"label_{label}"), f"label_{label}"), F.lit(label)) for label in REGISTRY_LABELS
    ]
    personal = ["bg_image", "bg_asset", "pfp_image", "pfp_asset", "last_update_address", "original_address", "id_hash",
                "pz_enabled", "last_edited_time", "portal", "designer", "socials", "virtual"]

    def attr(field: str, default: Column | None = None) -> Column:
        if not has_old:
            value = attrs[field]
        else:
            value = F.when(attrs.isNotNull(), attrs[field]).otherwise(old(field))
        return (F.coalesce(value, default) if default is not None else value).alias(field)

    exists = first.isNotNull()
    if has_old:
        exists = exists | F.col("old").isNotNull()
    return part.select(
        name,
        F.coalesce(owned("owner_hex") if not has_old else F.coalesce(F.col("owned.owner_hex"), F.col("old.hex")),
                   first["owner_hex"]).alias("hex"),
        F.coalesce(*([old("policy")] if has_old else []), first["policy"]).alias("policy"),
        F.when(F.coalesce(F.col("is_virtual"), F.lit(False)) | F.coalesce(old("handle_type") == "virtual_subhandle", F.lit(False)),
               F.lit("virtual_subhandle"))
        .otherwise(assets.handle_type(name, F.lit(None))).alias("handle_type"),
        *attributes.name_attributes(name),
        F.coalesce(F.col("place")["holder"], old("holder"), first_holder).alias("holder"),
        address.alias("address"),
        F.map_concat(F.create_map(F.lit("ada"), address), extra).alias("resolved_addresses"),
        F.coalesce(kept(F.col("utxo"), "utxo"), F.lit("")).alias("utxo"),
        kept(F.col("reference_utxo"), "reference_utxo").alias("reference_utxo"),
        F.coalesce(owned("lovelace"), F.lit(0)).cast("decimal(38,0)").alias("lovelace"),
        owned("script").alias("script"),
        owned("datum").alias("datum"),
        owned("datum").isNotNull().alias("has_datum"),
        F.greatest(F.coalesce("copies", old("amount"), F.lit(1)), F.lit(1)).cast("bigint").alias("amount"),
        F.least(F.coalesce(F.col("minted"), first["slot"]), *([old("created_slot_number")] if has_old else [F.lit(None)]))
        .alias("created_slot_number"),
        F.greatest(F.col("updated"), *([old("updated_slot_number")] if has_old else [F.lit(None)]),
                   *([F.when(F.col("old").isNull(), first["slot"])] if has_old else [first["slot"]]))
        .alias("updated_slot_number"),
        attr("og_number", F.coalesce(F.col("listed_og"), F.lit(0)).cast("bigint")), attr("image", F.lit("")), attr("version", F.lit(0)),
        attr("image_hash", F.lit("")), attr("standard_image_hash", F.lit("")), attr("standard_image", F.lit("")),
        attr("svg_version", F.lit("0")),
        *[attr(f) for f in personal],
        F.coalesce(kept(F.col("default"), "default"), F.lit(False)).alias("default"),
        (F.col("settings") if not has_old else F.coalesce("settings", old("settings"))).alias("settings"),
        *[F.coalesce(kept(F.col(f"label_{label}"), f"label_{label}"), F.lit(False)).alias(f"label_{label}")
          for label in REGISTRY_LABELS],
        F.concat_ws("", *labels).alias("registry_labels"),
        exists.alias("exists"),
    )
