"""From raw nested records to the star schema: normalize, hash, intern, build.

Everything is column expressions; no record is handled in Python.  Surrogate ids are stable: a key
keeps its id from the seed, a new key gets the next one beyond the high-water mark, and the id of a
key that is no longer used is never given again.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times
from ..model import SEVERITIES, Corpus, Made, once
from ..sources.store import written

# Shape of a raw record and the codes of its words.
_METRIC = "struct<baseScore: string, baseSeverity: string, vectorString: string>"
_CONTAINER = f"""struct<title: string, descriptions: array<struct<lang: string, value: string>>, rejectedReasons: array<struct<lang: string, value: string>>,
affected: array<struct<vendor: string, product: string, defaultStatus: string, versions: array<struct<status: string, version: string, lessThan: string, lessThanOrEqual: string, versionType: string>>>>,
problemTypes: array<struct<descriptions: array<struct<cweId: string, description: string>>>>, references: array<struct<url: string>>,
metrics: array<struct<cvssV4_0: {_METRIC}, cvssV3_1: {_METRIC}, cvssV3_0: {_METRIC}, cvssV2_0: {_METRIC}, other: struct<type: string, content: struct<options: array<map<string, string>>>>>>>"""
RECORD = f"struct<cveMetadata: struct<cveId: string, state: string, assignerShortName: string, dateReserved: string, datePublished: string, dateUpdated: string>, containers: struct<cna: {_CONTAINER}, adp: array<{_CONTAINER}>>>".replace("\n", " ")
STATES = {"PUBLISHED": 1, "REJECTED": 2}
STATUSES = {"affected": 1, "unaffected": 2, "unknown": 3}
DEFAULT_ORDER = {1: 0, 3: 1, 2: 2}  # affected before unknown before unaffected
NAMED = "struct<cveMetadata: struct<cveId: string>>"
VERSIONS = (("cvssV4_0", 4), ("cvssV3_1", 31), ("cvssV3_0", 30), ("cvssV2_0", 2))  # by preference
SSVC = {"Exploitation": {"none": 0, "poc": 1, "active": 2}, "Automatable": {"no": 0, "yes": 1}, "Technical Impact": {"partial": 0, "total": 1}}


def _code(c: Column, words: dict[str, int], otherwise=None) -> Column:
    out = F.when(c.isNull(), F.lit(otherwise))
    for word, code in words.items():
        out = out.when(F.lower(c) == word.lower(), code)
    return out.otherwise(F.lit(otherwise)).cast("int")


def parsed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw: path (each once), text.  Records (path, id, r) and what was skipped (path, reason): not JSON, text that can't be stored, no usable id, or an id that an earlier path has.

    A first pass tells each path's id and what is wrong with it, which is a narrow table; ids of several paths are found in that.  A second pass parses the records where they lie, so no text is shuffled."""
    found = F.from_json("text", NAMED, {"mode": "PERMISSIVE"})["cveMetadata"]["cveId"]
    is_record = found.isNotNull() | F.get_json_object("text", "$.cveMetadata").isNotNull()
    told = raw.select("path", found.alias("found"), F.coalesce(is_record, F.lit(False)).alias("is_record"), T.storable(F.col("text")).alias("storable"))
    told = told.withColumn("id", _identifier(F.col("found")))
    reason = F.when(~F.col("is_record"), "not a record").when(~F.col("storable"), "text that can't be stored").when(F.col("id").isNull(), "no usable id")
    told = written(told.select("path", "id", reason.alias("reason")), "paths")
    sound = told.filter("reason is null")
    # Ids of several paths: the first path has them.
    twice = sound.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("first")).filter("n > 1").select("id", "first")
    # The id is read by itself again: taken from the whole record, it would have that parsed for the filter as well as for the result.
    rows = raw.filter(T.storable(F.col("text"))).select("path", _identifier(found).alias("id"), "text").filter("id is not null")
    good = rows.join(twice, "id", "left").filter("first is null or path = first").select("path", "id", F.from_json("text", RECORD, {"mode": "PERMISSIVE"}).alias("r"))
    later = sound.join(twice, "id").filter("path <> first").select("path", F.lit("id seen before").alias("reason"))
    return good, told.filter("reason is not null").select("path", "reason").unionByName(later)


def _identifier(text: Column) -> Column:
    """The id that a record tells, in upper case; null if it is none."""
    id = F.upper(F.trim(text))
    return F.when(T.is_cve_id(id), id)


def _score(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")) & c.rlike(r"^[0-9.eE+-]+$"), x)


def _field(name: str):
    return lambda x: x[name]


def _stated(point: str, words: dict[str, int]):
    return lambda option: _code(F.element_at(option, point), words)


def cvss_pick(metrics: Column) -> dict[str, Column]:
    """Of each version, by preference, the first metric with a score; ``cvss_best`` takes the first of these."""
    return {f"cvss{version}": F.get(F.filter(F.transform(metrics, _field(name)), _has_score), 0) for name, version in VERSIONS}


def _has_score(x: Column) -> Column:
    return _score(x["baseScore"]).isNotNull()


def cvss_best() -> Column:
    """ver, metric over the columns of ``cvss_pick``; null if there is none."""
    best = None
    for _, version in VERSIONS:
        metric = F.col(f"cvss{version}")
        pick = F.when(metric.isNotNull(), F.struct(F.lit(version).alias("ver"), metric.alias("metric")))
        best = pick if best is None else F.coalesce(best, pick)
    return best


def ssvc_merge(options: Column) -> dict[str, Column]:
    """Each decision point from the first container, in order, that states it in words that are known."""
    names = {"Exploitation": "ssvc_expl", "Automatable": "ssvc_auto", "Technical Impact": "ssvc_impact"}
    return {names[point]: F.get(F.filter(F.transform(options, _stated(point, words)), lambda x: x.isNotNull()), 0) for point, words in SSVC.items()}


def _gathered(containers: Column, field: str) -> Column:
    """All elements of a list field over containers, in order, without nulls."""
    return F.filter(F.flatten(F.filter(F.transform(containers, _field(field)), lambda x: x.isNotNull())), lambda x: x.isNotNull())


def normalized(records: DataFrame) -> DataFrame:
    """One projection a record: scalars, and lists of products, versions, references and weaknesses in canonical order.

    In steps, each of which names what the next ones read more than once, so nothing is worked out twice."""
    cna, adp = F.col("r.containers.cna"), F.coalesce(F.col("r.containers.adp"), F.array().cast(f"array<{_CONTAINER}>".replace("\n", " ")))
    present = lambda x: F.filter(x, lambda c: c.isNotNull())
    step = records.select("id", F.col("r.cveMetadata").alias("meta"), cna.alias("cna"), present(F.concat(F.array(cna), adp)).alias("own_first"), present(F.concat(adp, F.array(cna))).alias("own_last"))
    usable = lambda a: (F.trim(a["vendor"]) != "") & (F.trim(a["product"]) != "")
    ssvc = F.filter(_gathered(F.col("own_last"), "metrics"), lambda m: m["other"]["type"] == "ssvc")
    step = step.select(
        "id",
        "meta",
        "cna",
        _gathered(F.col("own_first"), "metrics").alias("metrics"),
        F.flatten(F.filter(F.transform(ssvc, lambda m: m["other"]["content"]["options"]), lambda x: x.isNotNull())).alias("options"),
        F.transform(F.filter(_gathered(F.array("cna"), "affected"), usable), _named).alias("affected"),
        _gathered(F.col("own_first"), "problemTypes").alias("problems"),
        _gathered(F.col("own_first"), "references").alias("links"),
    )
    step = step.withColumns({**cvss_pick(F.col("metrics")), **ssvc_merge(F.col("options")), "pairs": F.array_distinct(F.transform("affected", lambda a: F.struct(a["vendor"].alias("vendor"), a["product"].alias("product"))))})
    step = step.withColumn("cvss", cvss_best())
    weaknesses = F.filter(F.flatten(F.filter(F.transform("problems", _field("descriptions")), lambda x: x.isNotNull())), lambda d: d["cweId"].isNotNull())
    urls = F.filter(F.transform("links", lambda x: F.trim(x["url"])), lambda u: u.isNotNull() & (u != ""))
    meta, metric = F.col("meta"), F.col("cvss.metric")
    return step.select(
        F.col("id").alias("cve_id"),
        F.regexp_extract("id", r"^CVE-(\d{4})", 1).cast("int").alias("year"),
        _code(meta["state"], STATES, 0).alias("state"),
        F.nullif(F.trim(meta["assignerShortName"]), F.lit("")).alias("cna"),
        times.iso_seconds(meta["datePublished"]).alias("published"),
        times.iso_seconds(meta["dateUpdated"]).alias("updated"),
        times.iso_seconds(meta["dateReserved"]).alias("reserved"),
        F.col("cvss.ver").alias("cvss_ver"),
        _score(metric["baseScore"]).alias("cvss_score"),
        _code(metric["baseSeverity"], SEVERITIES).alias("cvss_sev"),
        metric["vectorString"].alias("cvss_vec"),
        "ssvc_expl",
        "ssvc_auto",
        "ssvc_impact",
        T.english(F.coalesce(F.col("cna.descriptions"), F.array())).alias("descr"),
        F.col("cna.title").alias("title"),
        T.english(F.coalesce(F.col("cna.rejectedReasons"), F.array())).alias("reason"),
        F.sort_array(F.transform("pairs", _product)).alias("products"),
        F.sort_array(F.flatten(F.transform("affected", _versions))).alias("versions"),
        F.sort_array(F.array_distinct(urls)).alias("refs"),
        F.sort_array(F.array_distinct(F.transform(weaknesses, lambda d: F.struct(F.upper(F.trim(d["cweId"])).alias("cwe"), d["description"].alias("descr"))))).alias("cwes"),
    )


def _named(a: Column) -> Column:
    """An affected product: names trimmed, its status as its place in DEFAULT_ORDER."""
    code = _code(a["defaultStatus"], STATUSES)
    place = F.when(code == 1, 0).when(code == 3, 1).when(code == 2, 2)
    return F.struct(F.trim(a["vendor"]).alias("vendor"), F.trim(a["product"]).alias("product"), place.alias("place"), a["versions"].alias("versions"))


def _product(p: Column) -> Column:
    """The gravest status that any statement about a product has."""
    least = F.array_min(F.transform(F.filter("affected", lambda a: (a["vendor"] == p["vendor"]) & (a["product"] == p["product"])), lambda a: a["place"]))
    status = F.when(least == 0, 1).when(least == 1, 3).when(least == 2, 2)
    return F.struct(p["vendor"].alias("vendor"), p["product"].alias("product"), status.alias("default_status"))


def _versions(a: Column) -> Column:
    def version(v: Column) -> Column:
        return F.struct(a["vendor"].alias("vendor"), a["product"].alias("product"), _code(v["status"], STATUSES, 0).alias("status"), v["version"].alias("version"), v["lessThan"].alias("lt"), v["lessThanOrEqual"].alias("lte"), v["versionType"].alias("vtype"))

    return F.transform(F.coalesce(a["versions"], F.array()), version)


def content_hash(projection: DataFrame, id_column: str = "cve_id") -> DataFrame:
    """id and the first 16 hex digits of a hash over all columns by name."""
    columns = sorted(c for c in projection.columns if c != id_column)
    return projection.select(id_column, F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 16).alias("hash"))


#: New ids that one task ranks, on average.
RANKED = 250_000


def number(keys: DataFrame, key: str, start: int) -> DataFrame:
    """key, id: ids from start + 1 in the order of md5(key), without an order over all rows in one task.

    Rows are ranked within buckets of the hash's first digits, as many as leave about RANKED rows to a
    bucket; the buckets' sizes, at most 65,536 rows, give each its offset."""
    digits = 1
    rows = keys.count()
    while rows > RANKED * 16**digits and digits < 4:
        digits += 1
    named = keys.select(key, F.md5(F.col(key).cast("string")).alias("__h")).withColumn("__b", F.substring("__h", 1, digits))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = named.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    return named.withColumn("__k", rank).join(F.broadcast(sizes), "__b").select(key, (F.lit(start) + F.col("__before") + F.col("__k")).cast("long").alias("id"))


def intern(seed: DataFrame | None, keys: DataFrame, key: str, high: int) -> DataFrame:
    """id, key, fresh for each distinct non-null key in use; seed: id, key."""
    used = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    if seed is None:
        return number(used, key, high).withColumn("fresh", F.lit(True))
    old = used.join(seed.select("id", key), key).withColumn("fresh", F.lit(False))
    new = number(used.join(seed.select(key), key, "left_anti"), key, high).withColumn("fresh", F.lit(True))
    return old.select("id", key, "fresh").unionByName(new.select("id", key, "fresh"))


def high_water(table: DataFrame, recorded: int = 0) -> int:
    return max(recorded, table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"])


def fingerprint(table: DataFrame) -> str:
    """16 hex digits over a table's rows, in whatever order they come."""
    columns = sorted(table.columns)
    row = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(*columns)).alias("x")).first()
    import hashlib

    return hashlib.sha256(f"{columns}{row['n']}:{row['h']}:{row['x']}".encode()).hexdigest()[:16]


@dataclass
class Marks:
    """High-water marks of all id spaces; they outlive the rows that set them.  Those of a build are made when they are asked for, with the ids."""

    high: Mapping[str, int] = field(default_factory=dict)


def _space(seed: Corpus | None, table: str, keys: DataFrame, was: Mapping[str, int], key: Column) -> tuple[DataFrame, int]:
    """id, key of an id space, written, and its mark; ``key``: that of a row of the seed's table."""
    old = getattr(seed, table) if seed else None
    high = max(was.get(table, 0), high_water(old) if old is not None else 0)
    ids = written(intern(old.select("id", key.alias("key")) if old is not None else None, keys, "key", high), f"ids-{table}")
    return ids.select("id", "key"), high + ids.filter("fresh").count()


def build(projection: DataFrame, seed: Corpus | None = None, marks: Marks | None = None) -> tuple[Corpus, Marks]:
    """The star schema of these projections; ids come from the seed where it has the key.

    The projections, and the ids of each lookup, are written once: everything else reads them.  Each
    table is made when it is first asked for, and so are the ids that it needs."""
    was = marks.high if marks else {}
    p = once(lambda: written(projection, "projection"))
    listed = lambda name: p().select("cve_id", F.explode(name).alias("x")).select("cve_id", "x.*")
    products, versions, weaknesses = (lambda: listed("products")), (lambda: listed("versions")), (lambda: listed("cwes"))
    refs = lambda: p().select("cve_id", F.explode("refs").alias("url"))
    host_of = F.nullif(T.host(F.col("url")), F.lit(""))
    # A product is named by its vendor's id and its own name.
    named = lambda: products().select("vendor", "product").distinct().join(lookup("vendor").select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor")), "vendor")
    pair = lambda name: F.concat_ws("\u0000", F.col("vendor_id").cast("string"), F.col(name))
    keys = {
        "cna": (lambda: p().select(F.col("cna").alias("key")), F.col("name")),
        "vendor": (lambda: products().select(F.col("vendor").alias("key")), F.col("name")),
        "vtype": (lambda: versions().select(F.col("vtype").alias("key")), F.col("name")),
        "host": (lambda: refs().select(host_of.alias("key")), F.col("name")),
        "cwe": (lambda: weaknesses().select(F.col("cwe").alias("key")), F.col("cwe")),
        "url": (lambda: refs().select(F.col("url").alias("key")), F.col("url")),
        "product": (lambda: named().select(pair("product").alias("key")), pair("name")),
        "cve": (lambda: p().select(F.col("cve_id").alias("key")), F.col("cve_id")),
    }
    spaces = Made({n: lambda n=n, make=make, key=key: _space(seed, n, make(), was, key) for n, (make, key) in keys.items()})
    lookup = lambda name, column="name": spaces[name][0].select("id", F.col("key").alias(column))

    def cwe() -> DataFrame:
        descr = weaknesses().filter(F.col("descr").isNotNull()).groupBy("cwe").agg(F.min_by("descr", "cve_id").alias("descr"))
        return lookup("cwe", "cwe").join(descr, "cwe", "left").select("id", "cwe", "descr")

    def url() -> DataFrame:
        return lookup("url", "url").withColumn("h", host_of).join(lookup("host").select(F.col("id").alias("host_id"), F.col("name").alias("h")), "h", "left").select("id", "url", "host_id")

    def product() -> DataFrame:
        return named().withColumn("key", pair("product")).join(spaces["product"][0], "key").select("id", "vendor_id", F.col("product").alias("name"))

    # Records.
    rows = lambda: p().join(lookup("cve", "cve_id"), "cve_id").join(lookup("cna").select(F.col("id").alias("cna_id"), F.col("name").alias("cna")), "cna", "left")
    of = lambda df, *columns: df.join(lookup("cve", "cve_id").withColumnRenamed("id", "rid"), "cve_id").drop("cve_id").withColumnRenamed("rid", "cve_id").select("cve_id", *columns)
    pid = lambda: product().join(lookup("vendor").select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor")), "vendor_id").select(F.col("id").alias("product_id"), "vendor", F.col("name").alias("product"))
    tables = {
        "cve": lambda: rows().select("id", "cve_id", "year", "state", "cna_id", "published", "updated", "cvss_ver", "cvss_score", "cvss_sev", "cvss_vec", "reserved", "ssvc_expl", "ssvc_auto", "ssvc_impact"),
        "cve_text": lambda: rows().filter("descr is not null or title is not null or reason is not null").select(F.col("id").alias("cve_id"), "descr", "title", "reason"),
        "cve_cwe": lambda: of(weaknesses().join(lookup("cwe", "cwe").withColumnRenamed("id", "cwe_id"), "cwe").select("cve_id", "cwe_id").distinct(), "cwe_id"),
        "cve_ref": lambda: of(refs().join(lookup("url", "url").withColumnRenamed("id", "url_id"), "url").select("cve_id", "url_id").distinct(), "url_id"),
        "cve_prod": lambda: of(products().join(pid(), ["vendor", "product"]), "product_id", "default_status"),
        "cve_ver": lambda: of(versions().join(pid(), ["vendor", "product"]).join(lookup("vtype").select(F.col("id").alias("v"), F.col("name").alias("vtype")), "vtype", "left").drop("vtype").withColumnRenamed("v", "vtype"), "product_id", "status", "version", "lt", "lte", "vtype"),
        "cwe": cwe,
        "product": product,
        "url": url,
    }
    tables |= {n: lambda n=n: lookup(n) for n in ("cna", "vendor", "host", "vtype")}
    high = Made({n: was[n] for n in was if n not in keys} | {n: lambda n=n: spaces[n][1] for n in keys})
    return Corpus(**{n: once(make) for n, make in tables.items()}), Marks(high)
