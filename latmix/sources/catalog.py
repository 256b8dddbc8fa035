"""A nested subject catalogue from JSON metadata, and its maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

#: Fields of a record with a meaning of their own; all others are open fields.
FIELDS = ("name", "population", "modality", "channel", "hospital", "rater", "protocol", "tissue", "type", "pth", "nam_modality", "nam_channel", "ix_img")
#: Extensions tried, in order, where a record names no image.
EXTENSIONS = (".nii", ".nii.gz", ".img", ".img.gz")
SCHEMA = T.StructType([T.StructField(f, T.IntegerType() if f == "ix_img" else T.StringType()) for f in FIELDS])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all JSON files below a folder, one object or a list of them a file; hidden files and folders are left out.

    ``open`` holds the fields without a meaning of their own, ``file`` the path, ``seq`` the order.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!.]*.[jJ][sS][oO][nN]").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file")).where(~F.regexp_replace("file", "^[a-z]+:/*", "/").rlike(r"/\.[^/]+"))
    one = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<map<string,string>>")).otherwise(F.array(F.from_json("value", "map<string,string>")))
    rows = raw.select("file", F.posexplode(one).alias("element", "rec"))
    return records(rows, F.struct("file", "element"))


def records(rows: DataFrame, seq: Column) -> DataFrame:
    """Typed fields, open fields and order, from a map column ``rec``."""
    get = lambda f: F.try_element_at("rec", F.lit(f)).cast("int" if f == "ix_img" else "string").alias(f)
    open_fields = F.map_filter("rec", lambda k, v: ~F.lower(k).isin(*FIELDS))
    return rows.select(*map(get, FIELDS), sorted_map(open_fields).alias("open"), F.col("file"), seq.alias("seq"))


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def validate(recs: DataFrame) -> DataFrame:
    """Records without a name are left out; defaults and trimmed paths."""
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("population", "modality", "channel", "rater", "hospital", "tissue")}
    return recs.where("name IS NOT NULL").withColumns(blank | {"protocol": F.coalesce("protocol", F.lit("unknown")), "pth": F.trim(F.coalesce("pth", F.lit("")))})


def subject_key(population="population", name="name") -> Column:
    return F.when(F.col(population) != "", F.concat_ws("_", population, name)).otherwise(F.col(name))


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^(/|[A-Za-z]:[\\/])")


def file_parts(path: Column) -> tuple[Column, Column, Column]:
    """(folder, stem, extension)"""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)$", 1)


def resolve_paths(recs: DataFrame, listing: DataFrame) -> DataFrame:
    """Empty paths become the file's sibling of the same stem, relative ones lie in the file's folder; missing: ''. listing: (path)."""
    folder, stem, _ = file_parts(F.col("file"))
    named = F.when(is_absolute(F.col("pth")), F.col("pth")).otherwise(F.concat(folder, F.lit("/"), F.col("pth")))
    sibling = F.coalesce(F.col("pth") == "", F.lit(False))
    # what a file can be asked for by: its path, or its path without an extension that is tried
    asked = [F.struct(F.lit(False).alias("__sibling"), F.col("path").alias("__key"), F.lit(0).alias("__n"))]
    asked += [F.when(F.col("path").endswith(e), F.struct(F.lit(True).alias("__sibling"), F.expr(f"left(path, length(path) - {len(e)})").alias("__key"), F.lit(n).alias("__n"))) for n, e in enumerate(EXTENSIONS)]
    known = listing.select("path", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("x")).groupBy("x.__sibling", "x.__key").agg(F.min_by("path", "x.__n").alias("__path"))
    keyed = recs.withColumns({"__sibling": sibling, "__key": F.when(sibling, F.concat(folder, F.lit("/"), stem)).otherwise(named)})
    return keyed.join(known, ["__sibling", "__key"], "left").withColumn("pth", F.coalesce("__path", F.lit(""))).select(*recs.columns)


def subjects(recs: DataFrame) -> DataFrame:
    """One row per subject: fields of the first record, nested modalities, channels, labels, segmentations, last open fields.

    Order is that of first sight; of open fields the last value wins. A record's parts become entries of
    one kind each, which are gathered by channel, then by modality, then by subject: one plan without
    joins, whose exchanges carry less from one to the next.
    """
    r = validate(recs).withColumn("subject", subject_key())
    kind = F.coalesce("type", F.lit("image"))
    shape = f"section string, a string, b string, v string, file struct<seq:{r.schema['seq'].dataType.simpleString()},modality:string,channel:string,ix_img:int,pth:string>, label struct<seq:{r.schema['seq'].dataType.simpleString()},rater:string,protocol:string,pth:string>, class struct<seq:{r.schema['seq'].dataType.simpleString()},tissue:string,pth:string>"
    entry = f"struct<{', '.join(':'.join(f.split(' ', 1)) for f in shape.split(', '))}>"
    none = F.lit(None)

    def part(section: str, a=none, b=none, v=none, file=none, label=none, klass=none) -> Column:
        return F.struct(F.lit(section), a, b, v, file, label, klass).cast(entry)

    image = part("image", F.col("modality"), F.col("channel"), file=F.struct("seq", "modality", "channel", "ix_img", "pth"))
    label = part("label", label=F.struct("seq", "rater", "protocol", "pth"))
    klass = part("segmentation", klass=F.struct("seq", "tissue", "pth"))
    own = F.when(kind == "image", F.array(image)).when(kind == "label", F.array(label)).when(kind == "segmentation", F.array(klass)).otherwise(F.array().cast(f"array<{entry}>"))
    opens = F.transform(F.map_entries("open"), lambda e: part("open", e["key"], v=e["value"]))
    entries = r.select("subject", "seq", "name", "population", "hospital", F.explode(F.concat(F.array(part("record")), own, F.coalesce(opens, F.array().cast(f"array<{entry}>")))).alias("e"))
    first = [F.min_by(c, "seq").alias(c) for c in ("name", "population", "hospital")]
    one = entries.groupBy("subject", "e.section", "e.a", "e.b").agg(
        F.min("seq").alias("seq"), F.count("*").alias("n"), *first, F.max_by("e.v", "seq").alias("v"), F.sort_array(F.collect_list("e.file")).alias("files"), F.sort_array(F.collect_list("e.label")).alias("labels"), F.sort_array(F.collect_list("e.class")).alias("classes")
    )
    channel = F.when(F.col("section") == "image", F.struct("seq", F.col("b").alias("channel"), F.size("files").alias("n")))
    two = one.groupBy("subject", "section", "a").agg(
        F.min("seq").alias("seq"), F.sum("n").alias("n"), *first, F.max_by("v", "seq").alias("v"), F.sort_array(F.collect_list(channel)).alias("channels"), F.first("labels").alias("labels"), F.first("classes").alias("classes")
    )
    is_of = lambda s: F.col("section") == s
    some = lambda c: F.when(F.size(c) > 0, c)
    gathered = two.groupBy("subject").agg(
        F.min("seq").alias("seq"), *first, F.max(F.when(is_of("record"), F.col("n"))).alias("records"),
        F.sort_array(F.collect_list(F.when(is_of("image"), F.struct("seq", F.col("a").alias("modality"), "channels")))).alias("modalities"),
        F.first(F.when(is_of("label"), F.col("labels")), True).alias("labels"), F.first(F.when(is_of("segmentation"), F.col("classes")), True).alias("segmentations"),
        F.sort_array(F.collect_list(F.when(is_of("open"), F.struct(F.col("a").alias("k"), "v")))).alias("open"),
    )
    return gathered.select("subject", "seq", "name", "population", "hospital", "records", some(F.col("modalities")).alias("modalities"), "labels", "segmentations", F.map_from_entries(some(F.col("open"))).alias("open"))


def merge_catalogues(*cats: DataFrame) -> DataFrame:
    """Of subjects in several catalogues the first one's entry stays."""
    rows = None
    for n, c in enumerate(cats):
        c = c.withColumn("__cat", F.lit(n))
        rows = c if rows is None else rows.unionByName(c, allowMissingColumns=True)
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("subject").orderBy("__cat"))).where("__n = 1").drop("__n", "__cat")


def keep_channels(cat: DataFrame, wanted: list[str]) -> DataFrame:
    """Of each subject's first modality, the named channels."""
    cut = lambda m: F.struct(m["seq"].alias("seq"), m["modality"].alias("modality"), F.filter(m["channels"], lambda c: c["channel"].isin(*wanted)).alias("channels"))
    return cat.withColumn("modalities", F.transform("modalities", lambda m, i: F.when(i == 0, cut(m)).otherwise(m)))


def populations(cat: DataFrame) -> DataFrame:
    """(population, seq, subjects, modalities) in order of first sight; modalities are those of its first subject."""
    return cat.groupBy("population").agg(F.min("seq").alias("seq"), F.count("*").alias("subjects"), F.min_by(F.size("modalities"), "seq").alias("n_modalities"))


def select_subjects(cat: DataFrame, quota, order: str = "seq") -> DataFrame:
    """The first subjects of every population: a number, or one by population (others keep all); one at least."""
    n = F.row_number().over(W.partitionBy("population").orderBy(order))
    if isinstance(quota, dict):
        chain = None
        for p, q in quota.items():
            chain = (F if chain is None else chain).when(F.col("population") == p, max(q, 1))
        limit = chain if chain is not None else F.lit(None).cast("int")
    else:
        limit = F.lit(max(quota, 1))
    return cat.withColumn("__n", n).where(limit.isNull() | (F.col("__n") <= limit)).drop("__n")


def dimension(recs: DataFrame, col: str) -> DataFrame:
    """(value, index from 1) in order of first sight."""
    seen = recs.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min("seq").alias("seq"))
    return seen.select("value", F.row_number().over(W.orderBy("seq")).alias("index"))


def image_dimension(images: DataFrame, dim: str = "dim") -> DataFrame:
    """(dimension): 3, or 2 where every image has one slice; images of both kinds are an error."""
    own = F.when(F.coalesce(F.get(dim, F.lit(2)), F.lit(1)) == 1, 2).otherwise(3)
    both = images.agg(F.min(own).alias("a"), F.max(own).alias("b")).where(F.col("a").isNotNull())
    return both.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.lit("images of two and of three dimensions")).cast("int")).alias("dimension"))


def validate_models(recs: DataFrame) -> DataFrame:
    """Records of model files: a missing type is an error."""
    return recs.withColumn("type", F.when(F.col("type").isNotNull(), F.col("type")).otherwise(F.raise_error(F.lit("a model record has no type")))).withColumn("modality", F.coalesce("modality", F.lit("")))


def set_field(rec: Column, field: str, value: Column) -> Column:
    """A record map with a field set, keys in order."""
    rest = F.map_filter(rec, lambda k, v: k != field)
    return sorted_map(F.map_concat(rest, F.create_map(F.lit(field), value.cast("string"))))


def rename_field(rec: Column, old: str, new: str, value: Column | None = None) -> Column:
    """A record map with a key renamed where it is present; its value stays unless another is given."""
    kept = F.map_filter(rec, lambda k, v: ~k.isin(old, new))
    moved = sorted_map(F.map_concat(kept, F.create_map(F.lit(new), (value if value is not None else F.element_at(rec, old)).cast("string"))))
    return F.when(F.map_contains_key(rec, old), moved).otherwise(rec)


def relative_paths(recs: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths become bare file names where such a file lies beside the record's."""
    folder, _, _ = file_parts(F.col("file"))
    name = F.regexp_extract("pth", "[^/]+$", 0)
    there = listing.select(F.col("path").alias("__beside"), F.lit(True).alias("__has")).distinct()
    out = recs.withColumn("__beside", F.concat(folder, F.lit("/"), name)).join(there, "__beside", "left")
    return out.withColumn("pth", F.when(F.col("__has"), name).otherwise(F.col("pth"))).select(*recs.columns)


def pretty_bytes(n: Column) -> Column:
    kb, mb, gb = F.ceil(n / 1024), F.ceil(n / 1024**2), F.ceil(n / 1024**3)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(kb.cast("string"), F.lit(" KB"))).when(n < 1024**3, F.concat(mb.cast("string"), F.lit(" MB"))).otherwise(F.concat(gb.cast("string"), F.lit(" GB")))


def write_records(recs: DataFrame, path: str) -> None:
    recs.write.mode("overwrite").json(path)


def save(cat: DataFrame, path: str) -> None:
    cat.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
