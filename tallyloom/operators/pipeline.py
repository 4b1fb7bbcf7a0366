"""Building a training set: validation, licence filters with one reason a drop, grouping, derived questions, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import rng
from tallyloom.functions import text as T
from tallyloom.functions import vectors as V
from tallyloom.functions.ranks import ranked
from tallyloom.operators import neartext
from tallyloom.operators.checks import canonical, leaf_text
from tallyloom.operators.relational import near_hashes
from tallyloom.workspace import Workspace

LICENSES = ("commercial-ok", "non-commercial", "unknown")
FREE_IMAGES = (4, 5, 6, 7, 8)
MIN_SOURCE = 50
START_CHUNK, LONGEST_CHUNK, SLICE = 0.35, 16, 4096
CJK = "[一-鿿]"


def once(records: DataFrame) -> DataFrame:
    """Each record once: the first load of its number."""
    w = Window.partitionBy("rec_key").orderBy(F.col("loaded_at").asc_nulls_last(), F.col("id").asc_nulls_last())
    return records.where("rec_key is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def blank(c: Column) -> Column:
    """Null, or nothing but one of the ways of writing nothing."""
    return c.isNull() | F.trim(c).isin("", "-", "nan", "None")


def question_errors(q: Column) -> Column:
    """Messages about one question, with its name in front."""
    k = F.coalesce(F.size(q["criteria"]), F.lit(0))
    n = F.coalesce(F.size(q["target"]), F.lit(0))
    sums = F.abs(V.total(F.coalesce(q["target"], F.array().cast("array<double>"))) - 1.0) > 1e-6
    rules = [
        (F.coalesce(q["instructions"], F.lit("")) == "", "instructions are missing"),
        (~q["type"].isin("noul", "choice", "score") | q["type"].isNull(), "unknown type"),
        (q["type"].isin("choice", "score") & ((k < 1) | (k > 255)), "1 to 255 options are needed"),
        ((q["type"] == "noul") & ~k.isin(0, 1, 2), "yes/no has other options"),
        (q["type"].isin("choice", "score") & (n != k), "target and options differ"),
        ((q["type"] == "noul") & (n != 2), "target needs two entries"),
        ((n > 0) & sums, "target does not sum to 1"),
        (F.exists(F.coalesce(q["target"], F.array().cast("array<double>")), lambda t: t.isNull() | (t < 0) | (t > 1)), "target outside 0 to 1"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.concat(F.coalesce(q["name"], F.lit("?")), F.lit(": "), F.lit(text))) for bad, text in rules)))


def record_errors(records: DataFrame) -> DataFrame:
    """The records with ``errors``: an array of messages, empty for a valid record."""
    need = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is missing"))
    image = F.exists(F.coalesce("images", F.array()), lambda i: i["path"].isNull() == i["url"].isNull())
    own = F.array(
        *(need(c) for c in ("id", "source", "split", "lang")),
        F.when(F.col("license").isNull() | ~F.col("license").isin(*LICENSES), "license is not known"),
        F.when(F.col("state_json").isNull() | (F.trim("state_json") == "null"), "state is missing"),
        F.when(image, "an image needs one of path and url"),
        F.when(F.coalesce(F.size("questions"), F.lit(0)) == 0, "questions are missing"),
        F.when(blank(F.col("grid_id")) & (F.col("split") == "train"), "grid_id is missing"),
    )
    asked = F.flatten(F.transform(F.coalesce("questions", F.array()), question_errors))
    return records.withColumn("errors", F.concat(F.array_compact(own), asked))


def tiered(records: DataFrame, tiers: DataFrame) -> DataFrame:
    """``tier_license``: the tier of the record's source; copyleft is non-commercial, none or another is unknown."""
    clean = tiers.groupBy(F.trim("source").alias("source")).agg(F.max("tier").alias("tier"))
    lic = F.when(F.col("tier") == "copyleft", "non-commercial").when(F.col("tier").isin(*LICENSES), F.col("tier")).otherwise("unknown")
    return records.join(clean, "source", "left").withColumn("tier_license", lic).drop("tier")


def image_licensed(records: DataFrame, images: DataFrame) -> DataFrame:
    """``image_license`` of the record's image number: by number, else where that number is a file name."""
    by_id = images.where("image_id is not null").groupBy(F.col("image_id").alias("coco_id")).agg(F.min("license_id").alias("by_id"))
    by_name = images.where("file_name is not null").groupBy(F.col("file_name").alias("coco_name")).agg(F.min("license_id").alias("by_name"))
    named = records.withColumn("coco_name", F.col("coco_id").cast("string"))
    return named.join(by_id, "coco_id", "left").join(by_name, "coco_name", "left").withColumn("image_license", F.coalesce("by_id", "by_name")).drop("by_id", "by_name", "coco_name")


def record_text(records: DataFrame) -> Column:
    """Normalised text of a record: the strings of its state in written order, then the instructions."""
    instructions = F.array_join(F.transform("questions", lambda q: F.coalesce(q["instructions"], F.lit(""))), " ")
    return F.lower(T.collapse(F.concat_ws(" ", leaf_text(False)(F.col("state_json")), instructions)))


def numbers_shown(records: DataFrame, held: bool) -> DataFrame:
    """``rec_key``, ``number``: image numbers of the field and of the paths; of held-out paths only those of validation images."""
    paths = F.flatten(F.transform(F.coalesce("images", F.array()), lambda i: F.array(i["path"], i["url"])))
    in_path = F.filter(F.transform(paths, T.held_image_number if held else T.any_image_number), lambda n: n.isNotNull())
    return records.select("rec_key", F.explode(F.array_compact(F.array_append(in_path, F.col("coco_id")))).alias("number")).distinct()


def held_out_hits(records: DataFrame, hashes: DataFrame | None = None, held_hashes: DataFrame | None = None) -> DataFrame:
    """``rec_key``, ``by_image``, ``by_text``, ``by_id``: train records that a pass against the held-out records hits.

    A text counts from 200 characters on where the record has images. ``hashes`` (rec_key, h) and ``held_hashes`` (h) are
    64-bit picture hashes, near within four bits.
    """
    ws = Workspace(records.sparkSession)
    train, held = records.where("split = 'train'"), records.where("split in ('calibration', 'validation', 'test')")
    known = records.where("split in ('train', 'calibration', 'validation', 'test')")
    text = known.select("rec_key", (F.col("split") == "train").alias("train"), (F.coalesce(F.size("images"), F.lit(0)) > 0).alias("pictured"), record_text(known).alias("text"))
    text = ws.put(text.where("text is not null and text <> ''").withColumn("tkey", F.xxhash64("text")), "texts")
    mine = text.where("train and (not pictured or length(text) >= 200)")
    near = neartext.near_keys(mine, text.where("not train"), ws)
    by_text = mine.join(near, "tkey", "left_semi").select("rec_key", F.lit("by_text").alias("pass"))
    by_id = numbers_shown(train, False).join(numbers_shown(held, True).select("number").distinct(), "number", "left_semi").select("rec_key", F.lit("by_id").alias("pass"))
    found = by_text.unionByName(by_id)
    if hashes is not None:
        near = near_hashes(hashes.select(F.col("rec_key").alias("id"), "h"), held_hashes.select(F.monotonically_increasing_id().alias("id"), "h"))
        found = found.unionByName(near.select(F.col("l").alias("rec_key"), F.lit("by_image").alias("pass")))
    return found.groupBy("rec_key").agg(*(F.max(F.col("pass") == c).alias(c) for c in ("by_image", "by_text", "by_id")))


def drop_reasons(records: DataFrame, tiers: DataFrame, images: DataFrame, exclude: tuple[str, ...], need_image: tuple[str, ...], hits: DataFrame) -> DataFrame:
    """``reason``: the first rule that drops a record, null if it stays.

    ``hits`` (see ``held_out_hits``) are the passes against held-out data, in the order image, text, image number.
    """
    full = image_licensed(tiered(records, tiers), images).join(hits, "rec_key", "left")
    reason = (
        F.when(F.col("source").isin(*exclude), "excluded source")
        .when(F.col("tier_license") != "commercial-ok", "license")
        .when(F.col("coco_id").isNotNull() & ~F.coalesce(F.col("image_license").isin(*FREE_IMAGES), F.lit(False)), "image license")
        .when(F.col("coco_id").isNull() & F.col("source").isin(*need_image), "image number")
        .when(F.col("by_image"), "held out image")
        .when(F.col("by_text"), "held out text")
        .when(F.col("by_id"), "held out id")
    )
    return full.withColumn("reason", reason).drop("by_image", "by_text", "by_id")


def manifest(records: DataFrame) -> DataFrame:
    """Records, kept, drops by reason and splits of each source; expects ``reason``."""
    reasons = {"excluded source": "excluded", "license": "license_drops", "image license": "image_license_drops", "image number": "image_number_drops", "held out image": "held_out_image_drops", "held out text": "held_out_text_drops", "held out id": "held_out_id_drops"}
    return records.groupBy("source").agg(
        F.count("*").alias("raw"), F.count_if(F.col("reason").isNull()).alias("kept"),
        *(F.count_if(F.col("reason") == r).alias(a) for r, a in reasons.items()),
        *(F.count_if(F.col("reason").isNull() & (F.col("split") == s)).alias(f"kept_{s}") for s in ("train", "calibration", "validation", "test")),
    )


def totals(records: DataFrame) -> DataFrame:
    """Records by split, by bucket and by language in one pass, and questions by type."""
    flat = records.select("split", F.when(F.coalesce(F.size("images"), F.lit(0)) > 0, "image").otherwise("text").alias("bucket"), "lang")
    sets = flat.groupingSets([[F.col("split")], [F.col("bucket")], [F.col("lang")]], F.col("split"), F.col("bucket"), F.col("lang")).agg(
        F.count("*").alias("n"), F.grouping_id().alias("g")
    )
    kind = F.when(F.col("g") == 3, "split").when(F.col("g") == 5, "bucket").otherwise("lang")
    value = F.when(F.col("g") == 3, F.col("split")).when(F.col("g") == 5, F.col("bucket")).otherwise(F.col("lang"))
    types = records.select(F.explode("questions").alias("q")).groupBy(F.lit("type").alias("kind"), F.col("q.type").alias("value")).agg(F.count("*").alias("n"))
    return sets.select(kind.alias("kind"), value.alias("value"), "n").unionByName(types)


def quality(records: DataFrame) -> DataFrame:
    """Per source: records, questions by type, the largest number of questions, invalid records, pictures, languages, and
    the length of the state's text: the whole part of the median, and the value at the whole part of 0.95 (n - 1)."""
    n = F.coalesce(F.size("questions"), F.lit(0))
    of = lambda t: F.sum(F.size(F.filter(F.coalesce("questions", F.array()), lambda q: q["type"] == t))).alias(t)
    agg = record_errors(records).groupBy("source").agg(
        F.count("*").alias("records"), F.sum(n).alias("questions"), of("noul"), of("choice"), of("score"), F.max(n).alias("most_questions"),
        F.count_if(F.size("errors") > 0).alias("invalid"), F.count_distinct("lang").alias("langs"), F.count_if(F.coalesce(F.size("images"), F.lit(0)) > 0).alias("pictured"),
    )
    chars = records.select("source", F.length(leaf_text(True)(F.col("state_json"))).alias("chars"))
    at = ranked(chars, "source", "chars", low="(n - 1) div 2", high="n div 2", p95="floor(0.95D * (n - 1))")
    chars = at.select("source", F.expr("(low + high) div 2").alias("median_chars"), F.col("p95").cast("long").alias("p95_chars"))
    return agg.join(chars, "source", "left").withColumn("per_record", F.bround(F.col("questions") / F.col("records"), 2))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Repeats of record ids, by source."""
    return records.groupBy("source").agg((F.count("id") - F.count_distinct("id")).alias("repeats"))


def duplicate_questions(records: DataFrame) -> DataFrame:
    """Questions asked again of the same state text beginning and the same images, after the first, by source.

    The key has 200 characters of the extracted state text and of the instruction, as in the reference, and the path of
    each image, else 64 characters of its URL.
    """
    shown = F.transform(F.coalesce("images", F.array()), lambda i: F.coalesce(i["path"], F.substring(i["url"], 1, 64), F.lit("")))
    asked = records.select("source", F.substring(leaf_text(True)(F.col("state_json")), 1, 200).alias("s"), shown.alias("shown"), F.explode("questions").alias("q"))
    keys = asked.groupBy("source", "s", "shown", F.substring(F.coalesce("q.instructions", F.lit("")), 1, 200).alias("i")).agg(F.count("*").alias("n"))
    return keys.groupBy("source").agg(F.sum(F.col("n") - 1).alias("repeats"))


def by_hash(c: Column, seed_share: float = 0.03) -> Column:
    """The split of a grid by its hash: two slices of 3 %, the rest is train."""
    h = rng.hash_unit(c)
    return F.when(h < seed_share, "calibration").when(h < 2 * seed_share, "validation").otherwise("train")


def covered_splits(records: DataFrame) -> DataFrame:
    """``source``, ``grid_id``, ``split``, ``h``: hash split by grid, repaired so that larger sources have every split.

    Sources under 50 records are train. A missing split takes the train grid of lowest hash, calibration before
    validation, if two train grids or more are left; the lowest hashes are per-source minima, so nothing is sorted.
    """
    grids = records.where(~blank(F.col("grid_id"))).groupBy("source", "grid_id").agg(F.count("*").alias("n"))
    grids = grids.withColumns({"h": rng.hash_unit(F.col("grid_id")), "split": by_hash(F.col("grid_id"))})
    train = F.when(F.col("split") == "train", F.struct("h", "grid_id"))
    by = grids.groupBy("source").agg(
        F.sum("n").alias("total"), F.count_if(F.col("split") == "train").alias("trains"), F.count_if(F.col("split") == "calibration").alias("cals"),
        F.count_if(F.col("split") == "validation").alias("vals"), F.min(train).alias("first"),
    )
    second = grids.join(by.select("source", "first"), "source").where((F.col("split") == "train") & (F.struct("h", "grid_id") > F.col("first"))).groupBy("source").agg(F.min(F.struct("h", "grid_id")).alias("second"))
    by = by.join(second, "source", "left")
    take_cal = (F.col("cals") == 0) & (F.col("trains") >= 2)
    for_cal = F.when(take_cal, F.col("first.grid_id"))
    left = F.col("trains") - take_cal.cast("int")
    for_val = F.when((F.col("vals") == 0) & (left >= 2), F.when(take_cal, F.col("second.grid_id")).otherwise(F.col("first.grid_id")))
    plan = by.select("source", "total", for_cal.alias("for_cal"), for_val.alias("for_val"))
    final = (
        F.when(F.col("total") < MIN_SOURCE, "train")
        .when(F.col("grid_id") == F.col("for_cal"), "calibration")
        .when(F.col("grid_id") == F.col("for_val"), "validation")
        .otherwise(F.col("split"))
    )
    return grids.join(plan, "source").select("source", "grid_id", "n", final.alias("split"))


def with_state_key(records: DataFrame) -> DataFrame:
    """Records of a grid with ``state_key``: equal for states that differ only in spelling and order of members."""
    return records.where(~blank(F.col("grid_id"))).withColumn("state_key", F.sha2(canonical(F.col("state_json")), 256))


def grid_groups(records: DataFrame) -> DataFrame:
    """States of each grid in first-seen order: the variant number, records and questions."""
    g = with_state_key(records).groupBy("source", "grid_id", "state_key").agg(F.min("rec_key").alias("first"), F.count("*").alias("records"), F.sum(F.size("questions")).alias("questions"))
    variant = F.row_number().over(Window.partitionBy("source", "grid_id").orderBy("first")) - 1
    return g.select("source", "grid_id", "state_key", variant.alias("variant"), "first", "records", "questions")


def pool(records: DataFrame, seed: int = 0) -> DataFrame:
    """Questions of each grid state, own and derived: ``source``, ``grid_id``, ``state_key``, ``rec_key``, ``name``, ``derived``."""
    r = Workspace(records.sparkSession).put(with_state_key(records).select("source", "grid_id", "state_key", "rec_key", "lang", "questions"), "keyed")
    own = r.select("source", "grid_id", "state_key", "rec_key", F.explode("questions").alias("q")).select("source", "grid_id", "state_key", "rec_key", F.col("q.name").alias("name"), F.lit("").alias("derived"))
    made = derived_yes_no(r, seed).select("rec_key", "name", F.col("kind").alias("derived"))
    return own.unionByName(r.select("source", "grid_id", "state_key", "rec_key").join(made, "rec_key"))


def chunked(records: DataFrame, seed: int = 0) -> DataFrame:
    """Questions of each grid state in a hashed order, cut into chunks of geometric size of at most 16.

    An item after the first starts a chunk with probability 0.35, and longer runs are cut at 16. Pools of more than
    SLICE questions are cut into slices of the order, so no task holds a whole one.
    """
    state = ["source", "grid_id", "state_key"]
    item = ["rec_key", "name", "derived"]
    ws = Workspace(records.sparkSession)
    q = ws.put(pool(records, seed), "pool")
    u, s = (rng.unit(seed + k, *map(F.col, item)) for k in (0, 1))
    sized = q.join(q.groupBy(*state).agg(F.count("*").alias("n")), state)
    sliced = sized.withColumns({"u": u, "s": s}).withColumn("slice", F.floor(F.col("u") * F.ceil(F.col("n") / SLICE)))
    order = Window.partitionBy(*state, "slice").orderBy("u", *item)
    started = sliced.withColumn("start", ((F.row_number().over(order) == 1) | (F.col("s") < START_CHUNK)).cast("int"))
    run = started.withColumn("run", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = run.withColumn("p", F.row_number().over(Window.partitionBy(*state, "slice", "run").orderBy("u", *item)) - 1)
    begun = placed.withColumn("begin", (F.col("p") % LONGEST_CHUNK == 0).cast("int"))
    upto = begun.withColumn("upto", F.sum("begin").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = ws.put(upto.select(*state, "slice", *item, "begin", "upto", "p"), "placed")
    chunks = upto.groupBy(*state, "slice").agg(F.sum("begin").alias("many"))
    before = F.sum("many").over(Window.partitionBy(*state).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    full = upto.join(chunks.withColumn("before", F.coalesce(before, F.lit(0))).drop("many"), [*state, "slice"])
    name = F.concat(F.lit("q"), (F.col("p") % LONGEST_CHUNK + 1).cast("string"))
    return full.select(*state, *item, (F.col("before") + F.col("upto") - 1).alias("chunk"), name.alias("new_name"))


def grid_records(records: DataFrame, seed: int = 0) -> DataFrame:
    """The records of the training set: one for each chunk of a grid state, with its id, questions and members.

    The id is source/grid#variant.chunk, the source only where the grid does not begin with it.
    """
    groups = grid_groups(records).select("source", "grid_id", "state_key", "variant")
    name = F.when(F.startswith("grid_id", F.concat("source", F.lit("/"))), F.col("grid_id")).otherwise(F.concat_ws("/", "source", "grid_id"))
    rows = chunked(records, seed).groupBy("source", "grid_id", "state_key", "chunk").agg(
        F.count("*").alias("questions"), F.count_if(F.col("derived") != "").alias("derived"), F.array_join(F.array_sort(F.collect_set("rec_key")), ",").alias("asked_in")
    )
    full = rows.join(groups, ["source", "grid_id", "state_key"])
    return full.select(F.concat(name, F.lit("#"), F.col("variant").cast("string"), F.lit("."), F.col("chunk").cast("string")).alias("id"), "questions", "derived", "asked_in")


def joined(instructions: Column, tail: Column, zh: Column) -> Column:
    """An instruction with a tail behind it, with end punctuation between them."""
    t = F.rtrim(instructions)
    ended = t.rlike(r"[.!?。！？:：]$")
    return F.concat(t, F.when(ended, F.lit("")).otherwise(F.when(zh, F.lit("。")).otherwise(F.lit("."))), F.when(zh, F.lit("")).otherwise(F.lit(" ")), tail)


def language(instructions: Column, lang: Column) -> Column:
    """zh for ideographs, en for other text, the record's language for none."""
    return F.when(F.coalesce(instructions, F.lit("")).rlike(CJK), "zh").when(F.coalesce(instructions, F.lit("")) != "", "en").otherwise(lang)


def derived_yes_no(records: DataFrame, seed: int = 0) -> DataFrame:
    """Yes/no questions derived from choices (three options or more, half of them) and scores (two levels, three tenths).

    A choice asks about a best option or a wrong one; a score asks whether the level is at least k.
    """
    q = records.select("rec_key", "lang", F.explode("questions").alias("q")).select("rec_key", "lang", "q.*")
    u = lambda k: rng.unit(f"{seed}.{k}", F.col("rec_key"), F.col("name"))
    n = F.size("target")
    place = F.sequence(F.lit(0), n - 1)
    best = F.filter(place, lambda i: F.element_at("target", i + 1) == F.array_max("target"))
    wrong = F.filter(place, lambda i: F.element_at("target", i + 1) != F.array_max("target"))
    pool = F.when((F.size(wrong) == 0) | (u("side") < 0.5), best).otherwise(wrong)
    choice = q.where("type = 'choice'").where((n >= 3) & (u("choice") < 0.5)).withColumn("pool", pool)
    choice = choice.withColumn("pick", F.element_at("pool", F.floor(u("pick") * F.size("pool")).cast("int") + 1))
    choice = choice.select("rec_key", "name", F.lit("choice").alias("kind"), F.col("pick"), F.element_at("target", F.col("pick") + 1).alias("p"))
    level = F.floor(u("level") * (n - 1)).cast("int") + 1
    score = q.where("type = 'score'").where((n >= 2) & (u("score") < 0.3)).withColumn("pick", level)
    tail = V.total(F.slice("target", F.col("pick") + 1, n))
    score = score.select("rec_key", "name", F.lit("score").alias("kind"), "pick", F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)).alias("p"))
    return choice.unionByName(score).select("rec_key", "name", "kind", "pick", F.round("p", 6).alias("p"))


def shared_meta(records: DataFrame) -> DataFrame:
    """Which of the promoted fields have one value in all records of a grid state."""
    same = lambda c: F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.min(c))
    cols = ("license", "lang", "cluster", "split", "coco_id", "flip_group", "flip_kind")
    g = with_state_key(records).groupBy("source", "grid_id", "state_key").agg(F.min("rec_key").alias("first"), F.count("*").alias("n"), *(same(c).alias(c) for c in cols))
    return g.drop("state_key")


def grid_ids(records: DataFrame) -> DataFrame:
    """Ids of the form source/grid#variant, the source only where the grid does not begin with it."""
    g = grid_groups(records)
    name = F.when(F.startswith("grid_id", F.concat("source", F.lit("/"))), F.col("grid_id")).otherwise(F.concat_ws("/", "source", "grid_id"))
    return g.select("first", F.concat(name, F.lit("#"), F.col("variant").cast("string")).alias("grid_record"))
