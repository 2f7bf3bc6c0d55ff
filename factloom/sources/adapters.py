"""From files to records to observations (SRC-01..16, OBS-01..06, STM-07).

Every adapter is a projection over a whole file: cells that can't be read become null where they stand, rows without what
their source requires are filtered, and nothing is decided row by row in Python. Only html that no fixed pattern
fits goes through a parser, in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import markup, text, values
from factloom.sources import mapping

# What each kind of source's word is worth, its label, and what an address list calls the one to take.
REGISTRY, NESTED, WEBSITE, CUSTOM = ("verified", 0.95), ("verified", 0.85), ("observed", 0.55), ("observed", 0.4)
REGISTERED = "Registered Address"
SELECTORS = {
    "canonical_name": "h1.company-name::text", "industry": ".company-industry::text", "website": ".company-website::text",
    "public_phone": ".company-phone::text", "public_email": ".company-email::text", "address": "address.company-address::text",
    "employee_count": ".employee-count::text",
}
PRODUCTS = ".company-product::text"
LARGEST_ANSWER, ATTEMPTS = 10 * 1024 * 1024, 3
# Keys' spelling matters (two of them differ in a capital only), so the inner objects are maps.
NESTED_SCHEMA = "data:struct<cin:string,company:string,masterData:struct<commonData:map<string,string>,companyData:map<string,string>>>"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01..03: a CSV with a header, or JSON (an array of objects, or one under ``records``), told by the first character."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.regexp_replace("value", r"^﻿?\s*", ""), 1, 1)).first()
    if first and first[0] in ("{", "["):
        return unwrapped(spark.read.text(path, wholetext=True).select(F.col("value").alias("content")))
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    return rows.toDF(*(c.lstrip("﻿") for c in rows.columns))


def unwrapped(documents: DataFrame) -> DataFrame:
    """SRC-02: rows of JSON documents in ``content``; anything but the two shapes is an error. Keys become columns."""
    body = F.regexp_replace("content", r"^﻿?\s*", "")
    bare = F.when(body.startswith("["), F.from_json(body, "array<map<string,string>>"))
    inner = F.from_json(body, "struct<records:array<map<string,string>>>")["records"]
    rows = F.coalesce(bare, inner, F.raise_error(F.lit("neither an array nor an object with records")).cast("array<map<string,string>>"))
    maps = documents.select(F.explode(rows).alias("m"))
    keys = sorted(r.k for r in maps.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect())  # the columns of one file
    return maps.select(*(F.col("m")[k].alias(k) for k in keys))


def registry_records(rows: DataFrame) -> DataFrame:
    """SRC-04: canonical columns as trimmed text, rows without a CIN dropped; ``valid`` by its length (SRC-05)."""
    fields = mapping.renamed(rows)
    clean = fields.select(*(F.coalesce(text.strip_all(F.col(c).cast("string")), F.lit("")).alias(c) for c in fields.columns))
    return clean.filter("cin <> ''").withColumns({"external_ref": F.col("cin"), "valid": F.length("cin") == 21})


def nested_records(documents: DataFrame, content: str = "content") -> DataFrame:
    """SRC-06, SRC-07: one record of each nested document; company data before common data, top-level keys before both."""
    d = F.from_json(F.col(content), f"struct<{NESTED_SCHEMA}>")["data"]
    company, common = d["masterData"]["companyData"], d["masterData"]["commonData"]
    pick = lambda *names: F.coalesce(*(company[n] for n in names), *(common[n] for n in names))
    listed = lambda x: F.from_json(x, "array<map<string,string>>")
    own = listed(company["MCAMDSCompanyAddress"])
    addresses = F.when(F.size(own) > 0, own).otherwise(listed(common["companyAddress"]))
    registered = F.filter(addresses, lambda a: a["addressType"] == REGISTERED)
    address = F.coalesce(F.get(registered, F.lit(0)), F.get(addresses, F.lit(0)))
    filled = lambda x: F.nullif(x, F.lit(""))
    spelled = lambda *names: F.coalesce(*(filled(address[n]) for n in names))
    pin = spelled("pinCode", "postalCode", "pincode", "pin")
    line = text.normalize_whitespace(
        F.concat_ws(
            ", ", spelled("addressLine1", "streetAddress", "addressline1", "streetAddress1", "line1"), spelled("addressLine2", "streetAddress2", "addressline2", "line2"),
            filled(address["city"]), filled(address["state"]), pin,
        )
    )
    out = documents.select(
        text.identifier(F.coalesce(d["cin"], pick("cin"))).alias("cin"),
        F.coalesce(d["company"], pick("companyName")).alias("company_name"),
        pick("companyStatus", "status").alias("company_status"),
        pick("classOfCompany").alias("company_class"),
        pick("companyCategory").alias("company_category"),
        pick("dateOfIncorporation").alias("date_of_registration"),
        pick("rocCode", "rocName", "ROCName").alias("roc"),
        pick("authorisedCapital", "authorizedCapital").alias("authorized_capital"),
        pick("paidupCapital", "paidUpCapital").alias("paidup_capital"),
        pick("pan").alias("pan"),
        address["city"].alias("city"),
        address["state"].alias("registered_state"),
        F.nullif(line, F.lit("")).alias("registered_office_address"),
        pin.alias("postal_code"),
    )
    return out.filter(F.coalesce(F.col("cin") != "", F.lit(False))).withColumns({"external_ref": F.col("cin"), "valid": F.length("cin") == 21})


def extracted(pages: DataFrame, selectors: dict[str, str], html: str = "html") -> DataFrame:
    """SRC-10: ``pages`` with an array of texts for each selector, of css or beginning with a slash; parsed in batches."""
    if not selectors:
        raise ValueError("a selector is needed")
    paths = [markup.xpath(x) if x.startswith("/") else markup.css(x) for x in selectors.values()]
    kept = [c for c in pages.columns if c not in selectors]
    schema = T.StructType([*pages.select(*(F.col(f"`{c}`") for c in kept)).schema.fields, *(T.StructField(n, T.ArrayType(T.StringType())) for n in selectors)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [markup.texts(x, paths) for x in part.column(html).to_pylist()]
                made = [pa.array([f[i] for f in found], pa.list_(pa.string())) for i in range(len(paths))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, *selectors])

    return pages.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, html]))).mapInArrow(run, schema)


def website_records(pages: DataFrame, html: str = "html", url: str = "url", selectors: dict[str, str] = SELECTORS) -> DataFrame:
    """SRC-08: what a page says of itself: all texts that a selector finds, joined; pages without a name are left out."""
    found = extracted(pages.select(F.col(url).alias("__url"), F.col(html).alias("__html")), {**selectors, "products": PRODUCTS}, "__html")
    joined = lambda c: F.nullif(text.normalize_whitespace(F.array_join(F.col(c), " ")), F.lit(""))
    out = found.select(
        F.col("__url").alias("external_ref"), *(joined(f).alias(f) for f in selectors), F.transform("products", text.normalize_whitespace).alias("products")
    )
    return out.filter(F.col("canonical_name").isNotNull())


def custom_records(rows: DataFrame, columns: dict[str, str], ordinal: str | None = None) -> DataFrame:
    """SRC-09, OBS-05: mapped rows with a reference (CIN, GSTIN, website, or the row's number) and whether they have a name."""
    fields = mapping.mapped(rows, columns)
    have = lambda f: [F.nullif(F.col(f), F.lit(""))] if f in fields.columns else []
    number = rows.select(F.col(f"`{ordinal}`")) if ordinal else None
    if number is not None:
        fields = rows.select(*(F.coalesce(text.strip_all(F.col(f"`{c}`").cast("string")), F.lit("")).alias(f) for c, f in columns.items()), F.col(f"`{ordinal}`").alias("__i"))
        fallback = F.concat(F.lit("row-"), F.col("__i").cast("string"))
    else:
        fallback = F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string"))  # the row's number in a file of one part
    ref = F.coalesce(*have("cin"), *have("gstin"), *have("website"), fallback)
    out = fields.withColumns({"external_ref": ref, "valid": F.col("legal_name") != ""})
    return out.drop("__i")


def _observed(records: DataFrame, kept: list[str], facts: list[tuple[str, Column, Column]], worth: tuple[str, float]) -> DataFrame:
    """Facts (field, raw, normalised) as rows; without raw text there is none. A normalised value may be null."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), raw.cast("string").alias("raw_value"), v.cast("string").alias("value")) for f, raw, v in facts))
    rows = records.select(*kept, F.inline(each))
    return rows.filter(F.coalesce(F.col("raw_value") != "", F.lit(False))).withColumns({"verification_type": F.lit(worth[0]), "confidence": F.lit(worth[1])})


def registry_observations(records: DataFrame, kept: list[str] | None = None, worth: tuple[str, float] = REGISTRY) -> DataFrame:
    """OBS-01, OBS-02: the registries' facts."""
    c = lambda n: F.coalesce(F.col(n), F.lit("")) if n in records.columns else F.lit("")
    both = F.concat_ws(" ", F.nullif(c("company_class"), F.lit("")), F.nullif(c("company_category"), F.lit("")))
    address = c("registered_office_address")
    postal = c("postal_code") if "postal_code" in records.columns else text.extract_postal_code(address)
    facts = [
        ("cin", c("cin"), text.identifier(c("cin"))),
        ("country_code", F.lit("IN"), F.lit("IN")),
        ("legal_name", c("company_name"), text.strip_all(c("company_name"))),
        ("canonical_name", c("company_name"), text.normalize_company_name(c("company_name"))),
        ("company_status", c("company_status"), F.lower(c("company_status"))),
        ("company_type", both, F.lower(both)),
        ("incorporation_date", c("date_of_registration"), values.flexible_date(c("date_of_registration"))),
        ("state", c("registered_state"), F.lower(text.strip_all(c("registered_state")))),
        ("registered_address", address, text.normalize_whitespace(address)),
        ("postal_code", postal, postal),
        ("roc", c("roc"), text.strip_all(c("roc"))),
        ("authorized_capital_inr", c("authorized_capital"), values.clean_number(c("authorized_capital"))),
        ("paidup_capital_inr", c("paidup_capital"), values.clean_number(c("paidup_capital"))),
    ]
    if worth == NESTED:
        facts += [("pan", c("pan"), text.identifier(c("pan"))), ("city", c("city"), F.lower(text.strip_all(c("city"))))]
    return _observed(records, kept or ["external_ref"], facts, worth)


def website_observations(records: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """OBS-03."""
    c = F.col
    size = values.employee_range(c("employee_count"))
    products = F.array_join("products", ", ")
    facts = [
        ("canonical_name", c("canonical_name"), text.normalize_company_name(c("canonical_name"))),
        ("industry", c("industry"), F.lower(text.strip_all(c("industry")))),
        ("website", c("website"), text.normalize_domain(c("website"))),
        ("public_phone", c("public_phone"), text.normalize_whitespace(c("public_phone"))),
        ("public_email", c("public_email"), F.lower(text.strip_all(c("public_email")))),
        ("address", c("address"), text.normalize_whitespace(c("address"))),
        ("postal_code", F.when(text.extract_postal_code(c("address")).isNotNull(), c("address")), text.extract_postal_code(c("address"))),
        *((f, F.when(size[n].isNotNull(), c("employee_count")), size[n]) for f, n in (
            ("employee_count", "count"), ("employee_range_min", "range_min"), ("employee_range_max", "range_max"))),
        ("products", products, products),
    ]
    return _observed(records, kept or ["external_ref"], facts, WEBSITE)


def custom_observations(records: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """OBS-04: each mapped cell by its type; a cell that isn't of its type is left out, its row isn't."""
    name = F.col("legal_name")
    facts = [("legal_name", name, text.strip_all(name)), ("canonical_name", name, text.normalize_company_name(name))]
    for field in records.columns:
        kind, c = mapping.CUSTOM_TYPES.get(field), F.col(field)
        if kind is None or field == "legal_name":
            continue
        if kind == "number":
            value = values.clean_number(c)
        elif kind == "date":
            value = values.flexible_date(c).cast("string")
        elif kind == "boolean":
            value = F.when(values.safe_bool(c), "True").otherwise("False")
        elif field == "country_code":
            value = text.identifier(c)
        elif field in ("state", "city", "country", "postal_code", "cin", "gstin"):
            value = text.strip_all(c)
        else:
            value = text.normalize_whitespace(c)
        fits = values.matches_type(c, kind) & value.isNotNull()
        facts.append((field, F.when(fits, c), value))
    return _observed(records.filter("valid"), kept or ["external_ref"], facts, CUSTOM)


#: STM-07: source types to (records, observations).
ADAPTERS: dict[str, tuple[Callable, Callable]] = {
    "government_dataset": (registry_records, registry_observations),
    "registry_api": (nested_records, lambda r, kept=None: registry_observations(r, kept, NESTED)),
    "company_website": (website_records, website_observations),
    "uploaded": (custom_records, custom_observations),
}


def window(rows: DataFrame, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """SRC-14: some of a file's rows, by their number."""
    out = rows.orderBy(order).offset(offset)
    return out if limit is None else out.limit(limit)


def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    """SRC-16."""
    return table.filter(F.col(key) == value).limit(1)


def discovered_schema(records: DataFrame, column: str) -> DataFrame:
    """SRC-18: of a column of JSON objects: every key, the kinds of value it has, and how many objects have it."""
    # values as variants: text keeps its quotes, so that "12" isn't 12
    pairs = records.select(F.explode(F.from_json(column, "map<string,variant>")).alias("field", "value"))
    told = F.schema_of_variant("value")
    kind = (
        F.when(told == "VOID", "null").when(told == "BIGINT", "int").when(told.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "float").when(told == "BOOLEAN", "bool")
        .when(told.startswith("ARRAY"), "list").when(told.startswith("OBJECT"), "dict").otherwise("str")
    )
    shown = F.col("value").cast("string")
    truthy = F.when(told.isin("ARRAY<VOID>", "OBJECT<>", "VOID") | shown.isin("", "0", "0.0", "false"), None).otherwise(shown)
    return pairs.select("field", kind.alias("kind"), truthy.alias("shown")).groupBy("field").agg(
        F.sort_array(F.collect_set("kind")).alias("kinds"), F.count("*").alias("seen"), F.min("shown").alias("sample")
    )


def fetch_verdict(status: Column) -> Column:
    """SRC-12, SRC-13: what an answer's status means: server errors are tried again, others aren't."""
    return (
        F.when(status < 400, "ok").when(status.isin(401, 403), "authentication").when(status == 404, "not_found").when(status == 429, "rate_limited")
        .when(status >= 500, "retry").otherwise("rejected")
    )


def fetched(attempts: DataFrame) -> DataFrame:
    """SRC-12: of each url's possible answers (url, attempt from 1, status, bytes; a null status is a failed connection): the one
    that counts. Failed connections and server errors are tried again, ``ATTEMPTS`` times in all; too long an answer is refused."""
    last = F.least(F.coalesce(F.min(F.when(F.col("status") < 500, F.col("attempt"))), F.lit(ATTEMPTS)), F.lit(ATTEMPTS))
    made = attempts.groupBy("url").agg(last.alias("attempts"))
    verdict = F.when(F.col("status").isNull(), "failed").when((F.col("status") < 400) & (F.col("bytes") > LARGEST_ANSWER), "too_large")
    answer = attempts.join(made, "url").filter("attempt = attempts")
    return answer.select("url", "attempts", "status", verdict.otherwise(fetch_verdict(F.col("status"))).alias("verdict"))


def crawl_order(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """SRC-11: a list (place, url) with the page that each gave, if one did: a list is answered in its order, repeats too."""
    return urls.join(pages, "url", "left").withColumn("found", F.col("html").isNotNull())
