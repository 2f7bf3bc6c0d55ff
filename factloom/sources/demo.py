"""Made-up companies, the same for the same seed (SRC-17): every cell is drawn by a digest of seed, column and row, so any
number of tasks makes the same rows, and one text says it to either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# How often each shape of size and revenue comes, of 100, and the words that cells are made of.
SHAPES = (("both_exact", 40), ("employees_unknown", 15), ("revenue_unknown", 15), ("both_range", 20), ("both_unknown", 10))
FIRST, SECOND = ("Sunrise", "Deccan", "Coastal", "Himalaya", "Ganga", "Vertex", "Lotus", "Apex"), ("Metals", "Textiles", "Foods", "Chemicals", "Motors", "Papers")
ENDINGS = ("Pvt Ltd", "Limited", "LLP", "Private Limited")
STATES = (("Maharashtra", "MH", ("Pune", "Mumbai", "Nagpur")), ("Gujarat", "GJ", ("Surat", "Rajkot")), ("Karnataka", "KA", ("Bengaluru", "Mysuru")), ("Tamil Nadu", "TN", ("Chennai", "Madurai")))
INDUSTRIES = (
    ("Metals", "27100", ("Casting", "Forging"), ("Pipes", "Rods", "Sheets"), ("Welding", "Coating")), ("Textiles", "17110", ("Weaving", "Dyeing"), ("Yarn", "Cloth", "Denim"), ("Printing", "Cutting")),
    ("Foods", "15130", ("Milling", "Baking"), ("Flour", "Biscuits", "Spices"), ("Packing", "Storage")), ("Motors", "34100", ("Parts", "Repair"), ("Gears", "Pumps", "Valves"), ("Testing", "Service")),
)
TYPES, YEARS = ("Private", "Public", "LLP"), (2023, 2024, 2025)
#: Columns in the order of the file.
COLUMNS = (
    "Company Name", "CIN", "GSTIN", "State", "City", "Postal Code", "Country Code", "Industry", "Sub Industry", "Company Type", "Employees", "Employee Range Min", "Employee Range Max",
    "Annual Revenue (INR)", "Revenue Range Min (INR)", "Revenue Range Max (INR)", "Revenue Year", "Website", "Phone", "Products", "Services", "Export Status", "Incorporation Date",
)

_DRAWS = {"spark": "CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)", "duckdb": "CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"}


def _sql(engine: str, ids: str, seed: int) -> str:
    """The rows as a query; ``ids``: a relation with the column id."""

    def draw(what: str, below: int) -> str:
        return "(" + _DRAWS[engine].format(x=f"concat('{seed}|{what}|', CAST(id AS VARCHAR(20)))") + f" % {below})"

    def case(place: str, options: tuple) -> str:
        return f"CASE {place} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(options)) + " END"

    pick = lambda what, options: case(draw(what, len(options)), options)
    padded = lambda x, n: f"lpad(CAST({x} AS VARCHAR(20)), {n}, '0')"
    whole = lambda x: f"CAST({x} AS VARCHAR(20))"
    by = lambda place, what, lists: f"CASE {place} " + " ".join(f"WHEN {i} THEN {pick(what, x)}" for i, x in enumerate(lists)) + " END"

    def two(place: str, what: str, lists: list[tuple]) -> str:  # two different ones of each list
        inner = [" ".join(f"WHEN {i} THEN '{x}, {y}'" for i, (x, y) in enumerate((a, b) for a in o for b in o if a != b)) for o in lists]
        return f"CASE {place} " + " ".join(f"WHEN {i} THEN CASE {draw(what, len(o) * (len(o) - 1))} {e} END" for i, (o, e) in enumerate(zip(lists, inner, strict=True))) + " END"

    edges, at = [], 0
    for name, weight in SHAPES:
        at += weight
        edges.append(f"WHEN roll < {at} THEN '{name}'")
    drawn = f"""SELECT id, {draw('state', len(STATES))} AS s, {draw('industry', len(INDUSTRIES))} AS n, {draw('shape', 100)} AS roll, 8 + {draw('size', 793)} AS size, 100000 * (10 + {draw('revenue', 9990)}) AS revenue,
      1998 + {draw('year', 26)} AS y, {pick('first', FIRST)} AS w1, {pick('second', SECOND)} AS w2, {pick('ending', ENDINGS)} AS w3 FROM {ids}"""
    shaped = f"SELECT *, CASE {' '.join(edges)} END AS shape, concat(w1, ' ', w2, ' ', w3) AS name FROM ({drawn}) a"
    exact_size, exact_revenue = "shape IN ('both_exact', 'revenue_unknown')", "shape IN ('both_exact', 'employees_unknown')"
    blank = lambda test, x: f"CASE WHEN {test} THEN {whole(x)} ELSE '' END"
    cells = (
        "name", f"concat('U', {case('n', tuple(x[1] for x in INDUSTRIES))}, {case('s', tuple(x[1] for x in STATES))}, {whole('y')}, {pick('kind', ('PTC', 'PLC'))}, {padded('id', 6)})",
        f"concat({whole('10 + ' + draw('gst', 28))}, 'ABCDE', {whole('1000 + ' + draw('gst2', 9000))}, 'F1Z', {whole('1 + ' + draw('gst3', 9))})", case("s", tuple(x[0] for x in STATES)),
        by("s", "city", [x[2] for x in STATES]), whole("100000 + " + draw("pin", 900000)), "'IN'", case("n", tuple(x[0] for x in INDUSTRIES)), by("n", "sub", [x[2] for x in INDUSTRIES]), pick("type", TYPES),
        blank(exact_size, "size"), blank("shape = 'both_range'", "size"), blank("shape = 'both_range'", "2 * size"), blank(exact_revenue, "revenue"), blank("shape = 'both_range'", "revenue"),
        blank("shape = 'both_range'", "2 * revenue"), f"CASE WHEN {exact_revenue} OR shape = 'both_range' THEN {pick('revenue year', YEARS)} ELSE '' END",
        "concat('https://', substr(replace(lower(name), ' ', ''), 1, 24), '.example')", f"concat('+91 ', {whole('70000 + ' + draw('phone', 30000))}, ' ', {whole('10000 + ' + draw('phone2', 90000))})",
        two("n", "products", [x[3] for x in INDUSTRIES]), two("n", "services", [x[4] for x in INDUSTRIES]), pick("export", ("true", "false")),
        f"concat({whole('y')}, '-', {padded('1 + ' + draw('month', 12), 2)}, '-', {padded('1 + ' + draw('day', 28), 2)})",
    )
    quote = "`" if engine == "spark" else '"'
    return "SELECT " + ", ".join(f"{c} AS {quote}{n}{quote}" for n, c in zip(COLUMNS, cells, strict=True)) + f" FROM ({shaped}) b"


#: The other engine's text, of 750 companies.
SQL = _sql("duckdb", "(SELECT unnest(range(1, 751)) AS id)", 42)


#: And of one for each customer.
CUSTOMERS_SQL = _sql("duckdb", "(SELECT c_custkey AS id FROM customer)", 42)


def companies_for(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A made-up company for each row of a table with a column ``id``."""
    return ids.sparkSession.sql(_sql("spark", "{ids}", seed), ids=ids.select("id"))


def companies(spark: SparkSession, count: int = 750, seed: int = 42) -> DataFrame:
    return companies_for(spark.range(1, count + 1), seed)
