import json
import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import evidence as E
from factloom.operators import health as H
from factloom.operators import resolution as R
from factloom.plans import catalogue
from factloom.sources import adapters as A
from factloom.sources import mapping as M
from factloom.sources import sinks as S
from factloom.streaming import file_drop

NOW = datetime(2024, 1, 1)
OBS = "company_id long, source_id long, field string, value string, verification_type string, collected_at timestamp, obs_id string"


def _brute(rows, weights):
    """The evidence of each (company, field), by the plain loop."""
    label = {"verified": 1.0, "observed": 0.7, "estimated": 0.5, "unknown": 0.1}
    groups = {}
    for c, s, f, v, vt, at, oid in sorted(rows, key=lambda r: (r[5], r[6])):
        groups.setdefault((c, f), []).append((s, v, vt, at))
    out = {}
    for key, obs in groups.items():
        score = [min(100, max(0, weights[s])) / 100 * label.get(vt, 0.1) * math.exp(-max(0, (NOW - at).total_seconds() / 86400) / 365) for s, _, vt, at in obs]
        keys = [(v or "").strip().lower() for _, v, _, _ in obs]
        votes = {}
        for k, x in zip(keys, score):
            n, best = votes.get(k, (0, 0))
            votes[k] = (n + 1, max(best, x))
        winner = max(votes, key=lambda k: votes[k])
        n, best = votes[winner]
        agreeing = [o for o, k in zip(obs, keys) if k == winner]
        strongest = max(agreeing, key=lambda o: label.get(o[2], 0.0))
        ratio = n / len(obs)
        out[key] = (strongest[1], strongest[2], min(1, max(0, best + min(0.15, 0.05 * (n - 1)) - (1 - ratio) * 0.3)))
    return out


def test_evidence_matches_the_plain_loop_in_any_order(spark):
    pick = random.Random(1)
    rows = [(pick.randrange(8), pick.randrange(4), pick.choice("ab"), pick.choice(["X", " x", "y", None]), pick.choice(["verified", "observed", "estimated", "rumour"]),
             NOW - timedelta(days=pick.randrange(900)), f"o{i:03}") for i in range(200)]
    weights = {0: 90, 1: 40, 2: 150, 3: -5}
    sources = spark.createDataFrame(list(weights.items()), "source_id long, reliability_weight int")
    want = _brute(rows, weights)
    for _ in range(2):
        pick.shuffle(rows)
        scores = E.scored(spark.createDataFrame(rows, OBS), sources, NOW)
        got = {(r.company_id, r.field): r for r in E.roll_up(scores).collect()}
        assert set(got) == set(want)
        for k, (value, label, confidence) in want.items():
            assert (got[k].value, got[k].verification_type) == (value, label) and abs(got[k].confidence - confidence) <= 0.00051
    plan = E.roll_up(scores)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan


def test_explanations_read_and_shuffle_observations_once(spark):
    plan = catalogue.queries()["evidence_explained"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\((?!l_orderkey|o_orderkey)", plan)) == 1


def test_explanations_of_odd_groups(spark):
    day = datetime(2023, 6, 1)
    many = [(1, i % 2, "a", "y" if i % 2 else " X", "verified" if i % 3 else None, day, f"m{i:04}") for i in range(3000)]
    tied = [(2, 2, "a", "late", "observed", day, "o1"), (2, 2, "a", "Early", "estimated", day, "o0"), (3, 2, "a", "b", "observed", day, "o2"), (3, 2, "a", None, "observed", day - timedelta(days=1), "o3")]
    dated = [(6, 0, "a", "x", "verified", at, f"p{i}") for i, at in enumerate([None, NOW - timedelta(days=365), NOW + timedelta(days=9)])] + [(7, 0, "a", "x", "observed", NOW - timedelta(days=d), f"q{d}") for d in (365, 730)]
    apart = [(None, 0, "a", "x", "verified", day, "n0"), (4, 0, None, "x", "verified", day, "n1"), (5, 0, "a", "x", "verified", None, "n2"), (5, 9, "a", "no source", "verified", day, "n3")]
    rows = spark.createDataFrame(many + tied + dated + apart, OBS)
    scores = E.scored(rows, spark.createDataFrame([(0, 90), (1, 90), (2, 0)], "source_id long, reliability_weight int"), NOW)
    got = {(r.company_id, r.field): r.explanation for r in E.explanations(scores, NOW).collect()}
    assert {k[0]: (e.agreeing_observation_count, e.total_observation_count, [tuple(v) for v in e.voices]) for k, e in got.items()} == {
        1: (1500, 3000, [(90, None, 500), (90, "verified", 1000)]),
        2: (1, 2, [(0, "estimated", 1)]),
        3: (1, 2, [(0, "observed", 1)]),
        5: (1, 1, [(90, "verified", 1)]),
        6: (3, 3, [(90, "verified", 3)]),
        7: (2, 2, [(90, "observed", 2)]),
    }
    rolled = {(r.company_id, r.field): r for r in E.roll_up(scores.filter("company_id IS NOT NULL AND field IS NOT NULL")).collect()}
    assert {k: (e.base_score, e.independent_source_bonus, e.conflict_penalty, e.agreement_ratio) for k, e in got.items()} == {k: (r.base, r.bonus, r.penalty, r.agreement) for k, r in rolled.items()}
    assert (got[6, "a"].base_score, got[7, "a"].base_score) == (0.9, round(0.63 / math.e, 3))
    assert len(got) == 6 and (got[2, "a"].base_score, got[2, "a"].conflict_penalty, got[1, "a"].independent_source_bonus) == (0.0, 0.15, 0.15)


def test_canonical_projection(spark):
    rows = [(1, "export_status", "Yes"), (1, "state", "tamil-nadu "), (1, "products", "a, b,,"), (1, "employee_count", "34.0"), (1, "annual_revenue_inr", "12.5"),
            (1, "incorporation_date", "2020-02-03"), (1, "canonical_name", "abc"), (1, "roc", "kept as evidence only"), (2, "employee_count", "many"), (2, "country_code", "in")]
    out = {r.company_id: r for r in E.canonical(spark.createDataFrame(rows, "company_id long, field string, value string")).collect()}
    assert (out[1].export_status, out[1].state, out[1].products, out[1].employee_count, str(out[1].annual_revenue_inr), str(out[1].incorporation_date), out[1].normalized_name) == (
        True, "Tamil-Nadu", ["a", "b"], 34, "12.50", "2020-02-03", "abc")
    assert out[2].employee_count is None and out[2].country_code == "IN" and "roc" not in out[2].asDict()


SIGNALS = "id long, cin string, gstin string, domain string, name string, state string, postal string, email_domain string"


def _sides(spark, left, right):
    fold = lambda rows, key: R.folded(spark.createDataFrame(rows, SIGNALS).withColumnRenamed("id", key), key)
    return fold(left, "record_id"), fold(right, "company_id")


def test_rules_and_decisions(spark):
    same = "abc industries"
    left = [(1, "c1 ", None, None, "x", None, None, None), (2, None, "g1", None, "y", None, None, None), (3, None, None, None, same, None, None, None),
            (4, None, None, None, same, None, "411019", None), (5, None, None, " D.example", "z", None, None, None), (6, None, None, None, "other name", None, None, None),
            (7, "bad", None, "d.example", "w", None, None, None), (8, None, None, None, "abc industris", "MH", None, None)]
    right = [(10, "C1", "G1", "d.example", same, "mh", "411019", None)]
    records, companies = _sides(spark, left, right)
    out = {r.record_id: r for r in R.resolve(records, companies).collect()}
    want = {1: (1.0, "auto_match"), 2: (0.95, "auto_match"), 3: (0.55, "review"), 4: (0.75, "review"), 5: (0.75, "review"), 6: (0.0, "no_match"), 7: (0.75, "review"), 8: (0.65, "review")}
    assert {k: (r.score, r.decision) for k, r in out.items()} == want
    assert out[7].signals.cin is False and {r.outcome for r in R.outcomes(R.resolve(records, companies)).filter("record_id = 6").collect()} == {"create"}
    plan = R.resolve(records, companies)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


@pytest.mark.parametrize("chunk", [4000, 5])
def test_best_candidates_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)  # the smaller one deals trigrams into chunks, and takes names through the steps
    pick = random.Random(2)
    name = lambda: " ".join(pick.choice(["steel", "tea", "works", "alpha", "beta", "delhi"]) for _ in range(pick.randint(1, 3)))
    left = [(i, None, None, None, name(), None, None, None) for i in range(30)]
    right = [(100 + i, None, None, None, name(), None, None, None) for i in range(60)]
    from factloom.functions.text import python_trigrams as grams

    records, companies = _sides(spark, left, right)
    got = {}
    for r in R.fuzzy_candidates(records, companies).collect():
        got.setdefault(r.record_id, set()).add(r.company_id)
    for i, *rest in left:
        a = grams(rest[3])
        near = [(len(a & b) / len(a | b), c[0]) for c in right if (b := grams(c[4])) is not None]
        want = {c for s, c in sorted((x for x in near if x[0] > 0.3), key=lambda x: (-x[0], x[1]))[:10]}
        assert got.get(i, set()) == want


def test_first_come_is_the_sequential_loop(spark):
    pick = random.Random(6)
    edges = sorted({tuple(sorted(pick.sample(range(40), 2))) for _ in range(70)})
    new = set()
    for n in range(40):
        if not any(b == n and a in new for a, b in edges):
            new.add(n)
    out = R.first_come(spark.createDataFrame(edges, "earlier long, later long"), spark.range(40).withColumnRenamed("id", "id"))
    assert {r.id for r in out.collect() if r.state == "new"} == new


def test_review(spark):
    queue = spark.createDataFrame([(1, "pending"), (2, "confirmed"), (3, "confirmed"), (4, "pending")], "candidate_id long, status string")
    verdicts = spark.createDataFrame([(1, "confirm"), (2, "reject"), (3, "confirm")], "candidate_id long, verdict string")
    assert {r.candidate_id: r.status for r in R.review(queue, verdicts).collect()} == {1: "confirmed", 2: "rejected", 3: "confirmed", 4: "pending"}


CSV = """CIN,COMPANY_NAME,COMPANY_STATUS(for efiling),COMPANY_CLASS,AUTHORIZED_CAP,DATE_OF_INCORPORATION,REGISTERED_STATE,REGISTERED_OFFICE_ADDRESS,SOME_FUTURE_FIELD
U12345MH2001PTC123456,"ABC Industries, Pvt. Ltd.",Active,Private,"1,00,000",05-03-2001,Maharashtra,"Plot 1, Pune 411019",x
,No Number,Active,Private,1,2001-01-01,,,x
SHORT,Bad Number,Active,Private,N.A.,2001-01-01,Delhi,,x
"""


def test_registry_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿" + CSV, encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"CIN": "U12345MH2001PTC123456", "COMPANY_NAME": "From JSON"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"CIN": "U1", "COMPANY_NAME": "Bare"}]))
    records = A.registry_records(A.read_rows(spark, str(tmp_path / "a.csv")))
    assert [(r.cin, r.valid) for r in records.orderBy("cin").collect()] == [("SHORT", False), ("U12345MH2001PTC123456", True)]
    facts = {(r.external_ref, r.field): r for r in A.registry_observations(records).collect()}
    ok = "U12345MH2001PTC123456"
    assert facts[ok, "canonical_name"].value == "abc industries" and facts[ok, "incorporation_date"].value == "2001-03-05"
    assert facts[ok, "postal_code"].value == "411019" and facts[ok, "authorized_capital_inr"].value == "100000" and facts[ok, "state"].value == "maharashtra"
    assert facts["SHORT", "authorized_capital_inr"].value is None and ("SHORT", "registered_address") not in facts
    assert A.registry_records(A.read_rows(spark, str(tmp_path / "b.json"))).first().company_name == "From JSON"
    assert A.registry_records(A.read_rows(spark, str(tmp_path / "c.json"))).first().company_name == "Bare"
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="neither an array"):
        A.read_rows(spark, str(tmp_path / "d.json"))


def test_nested_documents(spark):
    company = {"cin": "X", "companyName": "Inner", "paidUpCapital": "5", "MCAMDSCompanyAddress": [
        {"addressType": "Other", "city": "Goa"}, {"addressType": "Registered Address", "city": "Pune", "state": "MH", "streetAddress1": "Plot 1", "postalCode": "411019"}]}
    docs = [json.dumps({"data": {"cin": "TOP", "company": "Top Name", "masterData": {"companyData": company, "commonData": {"companyStatus": "Active", "paidUpCapital": "9"}}}}), '{"data": {}}', "no json"]
    out = A.nested_records(spark.createDataFrame([(d,) for d in docs], "content string")).collect()
    assert [(r.cin, r.company_name, r.company_status, r.paidup_capital, r.city, r.postal_code, r.registered_office_address) for r in out] == [
        ("TOP", "Top Name", "Active", "5", "Pune", "411019", "Plot 1, Pune, MH, 411019")]


def test_websites(spark):
    html = """<h1 class="big company-name"> Sunrise Metals Ltd </h1><p class='company-industry'>Metal  Work</p><a class="company-website">https://www.Sun.example/x</a>
    <span class="company-email">Info@Sun.example</span><address class="company-address">Plot 2 Pune 411019</address><b class="employee-count">50-200 employees</b>
    <i class="company-product">Rods</i><i class="company-product">Bars</i>"""
    records = A.website_records(spark.createDataFrame([("u1", html), ("u2", "<p>nothing</p>")], "url string, html string"))
    facts = {r.field: r.value for r in A.website_observations(records).collect()}
    assert facts == {"canonical_name": "sunrise metals", "industry": "metal work", "website": "sun.example", "public_email": "info@sun.example", "address": "Plot 2 Pune 411019",
                     "postal_code": "411019", "employee_range_min": "50", "employee_range_max": "200", "products": "Rods, Bars"}


def test_custom_files(spark):
    rows = spark.createDataFrame([(0, "Abc Ltd", "", "Delhi", "12x"), (1, " ", "C2", "Goa", "5"), (2, "Def", "C3", "Goa", "1,000")], "i long, `Company Name` string, Number string, State string, Turnover string")
    columns = {"Company Name": "legal_name", "Number": "cin", "State": "state", "Turnover": "annual_revenue_inr"}
    records = A.custom_records(rows, columns, "i")
    assert {r.external_ref: r.valid for r in records.collect()} == {"row-0": True, "C2": False, "C3": True}
    facts = {(r.external_ref, r.field): r.value for r in A.custom_observations(records).collect()}
    assert ("row-0", "annual_revenue_inr") not in facts and facts["row-0", "canonical_name"] == "abc" and facts["C3", "annual_revenue_inr"] == "1000"
    for bad in ({}, {"State": "state"}, {"Company Name": "legal_name", "State": "nothing"}, {"Company Name": "legal_name", "State": "legal_name"}, {"Absent": "legal_name"}):
        with pytest.raises(M.MappingError):
            M.mapped(rows, bad)


def test_mapping_comparison():
    found = M.compare(["cin", "Company_Status (x)", "NEW_ONE"])
    assert found.unknown == ["NEW_ONE"] and found.matched == ["cin", "company_status"] and "roc" in found.missing and found.missing_required == []


def test_reports(spark):
    jobs = spark.createDataFrame([(1, 7, "success", NOW, 5, None), (2, 7, "failed", NOW + timedelta(1), 0, "e2"), (3, 7, "partial", NOW + timedelta(2), 2, "e3")],
                                 "job_id long, source_id long, status string, created_at timestamp, records_updated long, error_summary string")
    jobs = jobs.withColumns({"started_at": F.col("created_at"), "finished_at": F.col("created_at")})
    r = H.source_health(jobs).first()
    assert (r.total_jobs, r.records_total, r.last_status, r.last_error, r.last_success_at) == (3, 7, "partial", "e2", NOW)
    sources = spark.createDataFrame([(7, "a", ""), (8, "b", "Shown")], "source_id long, name string, display_name string")
    assert {x.source_id: (x.shown, x.total_jobs) for x in H.health_of_all(sources, jobs).collect()} == {7: ("a", 3), 8: ("Shown", 0)}
    assert [x.label for x in H.confidence_histogram(spark.createDataFrame([(1.0,)], "confidence double")).collect()] == ["100-120%"]
    rows = spark.createDataFrame([(1, "", "A", None, "x", "N.A."), (2, "S", "a ", "d", "", "0"), (3, "S", "B", "d", "x", "")], "row long, cin string, name string, registered string, state string, capital string")
    assert tuple(H.import_quality(rows).first()) == (3, 1, 2, 1, 1, 1, 1, 1)


def test_rate_limit_is_the_plain_loop(spark):
    pick = random.Random(4)
    calls = [(pick.randrange(3), NOW + timedelta(seconds=pick.randrange(400)), 2, i) for i in range(120)]
    want = {}
    for s in range(3):
        held = []
        for _, at, _, i in sorted((c for c in calls if c[0] == s), key=lambda c: (c[1], c[3])):
            held = [t for t in held if t > at - timedelta(seconds=60)]
            want[i] = len(held) < 2
            if want[i]:
                held.append(at)
    out = H.allowed_calls(spark.createDataFrame(calls, "source_id long, at timestamp, limit_per_minute int, call_id long"))
    assert {r.call_id: r.allowed for r in out.collect()} == want


def test_sinks(spark, tmp_path):
    obs = spark.createDataFrame([(1, 5, "f")], "company_id long, source_id long, field string")
    for day in (1, 2):
        S.append_observations(obs, str(tmp_path / "obs"), datetime(2024, 1, day))
    assert spark.read.parquet(str(tmp_path / "obs")).count() == 2
    good, bad = S.split_bad(spark.createDataFrame([("1",), ("x",), (None,)], "v string"), F.col("v").try_cast("int").isNotNull())
    assert (good.count(), bad.count()) == (1, 2)
    (tmp_path / "f.txt").write_text("abc")
    meta = S.provenance(spark, str(tmp_path / "f.txt")).first().metadata
    assert meta["source_file"] == "f.txt" and meta["sha256"].startswith("ba7816bf") and meta["bytes"] == "3"
    S.write_csv(obs, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == obs.columns


def test_stream_takes_each_observation_once(spark, tmp_path):
    rows = [("o1", 1, 2, "f", "v", "verified", NOW), ("o1", 1, 2, "f", "v", "verified", NOW), ("o2", 1, 3, "f", "v", "observed", NOW)]
    spark.createDataFrame(rows, file_drop.OBSERVATION).write.parquet(str(tmp_path / "in"))
    seen = []
    q = file_drop.run_available(file_drop.observations(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, _: seen.extend(r.obs_id for r in df.collect()))
    q.awaitTermination()
    assert sorted(seen) == ["o1", "o2"]
    counted = []
    q = file_drop.run_available(file_drop.counts(file_drop.observations(spark, str(tmp_path / "in"))), str(tmp_path / "cp2"), lambda df, _: counted.extend(df.collect()), "update")
    q.awaitTermination()
    assert {r.source_id: r.observations for r in counted} == {2: 1, 3: 1}


def test_demo_companies_are_the_same_for_a_seed(spark):
    from factloom.sources import demo

    rows = demo.companies(spark, 500, 7).collect()
    assert sorted(rows) == sorted(demo.companies(spark, 500, 7).repartition(5).collect()) and rows != demo.companies(spark, 500, 8).collect()
    assert len(rows) == len({r.CIN for r in rows}) == 500 and all(len(r.CIN) == 21 for r in rows) and rows[0].__fields__ == list(demo.COLUMNS)
    # a row's shape shows in which of its cells are filled
    shape = {(True, False, True, False): "both_exact", (False, False, True, False): "employees_unknown", (True, False, False, False): "revenue_unknown", (False, True, False, True): "both_range",
             (False, False, False, False): "both_unknown"}
    cells = ("Employees", "Employee Range Min", "Annual Revenue (INR)", "Revenue Range Max (INR)")
    count = Counter(shape[tuple(r[c] != "" for c in cells)] for r in rows)
    assert all(abs(count[name] / 5 - weight) < 8 for name, weight in demo.SHAPES)
    assert all(a != b for r in rows for a, b in [r.Products.split(", ")])


def test_selectors_over_markup():
    from factloom.functions import markup as M

    html = "<div id=a class='x y'><p>one<b>two</b>three<p>four</div><div class=x><img src='i.png'><p lang=de>f&uuml;nf</p></div><!-- <p>no</p> --><p>"
    found = lambda *s: M.texts(html, [M.xpath(x) if x[0] == "/" else M.css(x) for x in s])
    assert found("p::text", "div p", "#a b::text", ".x.y > p::text", "div > b::text") == [["one", "three", "four", "fünf"], ["onetwothree", "four", "fünf"], ["two"], ["one", "three", "four"], []]
    assert found("img::attr(src)", "//div[@class='x']/p/text()", "//p/@lang", "//div//b") == [["i.png"], ["fünf"], ["de"], ["two"]]
    assert M.texts(None, [M.css("p")]) == [[]] and M.texts("a<b", [M.css("b")]) == [[]]
    for bad in ("", "p::nothing", "p[", "::text"):
        with pytest.raises(ValueError):
            M.css(bad)
    with pytest.raises(ValueError):
        M.xpath("//p[1]")


def test_saved_searches_refuse_what_they_cannot_do(spark):
    from factloom.operators import filter_tree as T, search as S

    companies = spark.createDataFrame([(1, "IN", "goa", 0.5), (2, "IN", "delhi", 0.1)], "company_id long, country_code string, state string, confidence double")
    seen = spark.createDataFrame([(2, 7)], "company_id long, source_id long")
    saved = {"filter_json": T.dumps(T.Condition("state", "!=", "string", "pune")), "source_scope": [7]}
    assert [r.company_id for r in S.run_saved(companies, saved, seen).collect()] == [2]
    for bad in ({**saved, "colour": 1}, saved):
        with pytest.raises(T.InvalidFilterConditionError):
            S.run_saved(companies, bad)


def test_a_domain_that_everybody_shares(spark):
    records = spark.createDataFrame([(i, "mail.example", f"name {i}") for i in range(30)], "record_id long, domain string, name string")
    companies = spark.createDataFrame([(i, "mail.example", "one name") for i in range(500)], "company_id long, domain string, name string")
    empty = [F.lit(None).cast("string").alias(n) for n in ("cin", "gstin")]
    found = R.exact_candidates(records.select("*", *empty), companies.select("*", *empty)).collect()
    assert {r.record_id: 0 for r in found}.keys() == set(range(30)) and {r.company_id for r in found} == set(range(10)) and len(found) == 300
    near = R.fuzzy_candidates(spark.createDataFrame([(1, "one name"), (2, "one nam")], "record_id long, name string"), companies).collect()
    assert {(r.record_id, r.company_id) for r in near} == {(i, c) for i in (1, 2) for c in range(10)}


def test_listings(spark):
    from factloom.operators import projections as P

    years = spark.createDataFrame([(1, "2020-21"), (1, "2022-23"), (2, "2024-25")], "company_id long, financial_year string")
    assert [r.financial_year for r in P.financial_history(years, 1).collect()] == ["2022-23", "2020-21"] and H.newest_financials(years).count() == 2
    gst = spark.createDataFrame([(1, "g1", False, "A"), (1, "g2", True, "Z"), (1, "g3", False, None)], "company_id long, gstin string, is_primary boolean, state string")
    assert [r.gstin for r in P.gst_registrations(gst, 1).collect()] == ["g2", "g1", "g3"]
    shown = P.company_out(spark.createDataFrame([(1, "x")], "company_id long, canonical_name string").withColumn("annual_revenue_inr", F.lit("1.5").cast("decimal(20,2)")))
    assert shown.columns == list(P.COMPANY) and dict(shown.dtypes)["annual_revenue_inr"] == "double"
    rows = spark.createDataFrame([("A", "12x"), (None, "3")], "legal_name string, employee_count string")
    assert tuple(H.custom_import_stats(rows, M.CUSTOM_TYPES).first()) == (2, 1, 1, 1)


def test_trigrams_of_one_side_meet_nothing(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 4)
    left, right = ([f"{word} {i:04d}" for i in range(0, 400, step)] for word, step in (("Supplier", 37), ("Customer", 7)))
    sides = [spark.createDataFrame([(x,) for x in names], "name string") for names in (left, right)]
    ranked = R.ranked_trigrams(*sides).localCheckpoint()
    alone = spark.createDataFrame([(x,) for x in ("cus", "ust", "mer", "sup", "lie")], "t string").select(F.xxhash64("t").alias("piece"))
    for side, own, other in (("on_left", "a", "b"), ("on_right", "b", "a")):
        assert not R._prefixes(ranked.filter(side), 0.3, own, other, 0).join(alone, "piece").count()
    got = {(r.left_name, r.right_name): r.similarity for r in R.similar_pairs(*sides, 0.3).collect()}
    sets = {x: text.python_trigrams(x) for x in [*left, *right]}
    want = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in left for y in right}
    assert got == {k: v for k, v in want.items() if v > 0.3}


def test_an_appended_batch_is_few_files(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS obs_id", "id % 5 AS source_id").repartition(8)
    S.append_observations(rows, str(tmp_path / "obs"), datetime(2024, 1, 1))
    assert len(list((tmp_path / "obs").rglob("*.parquet"))) == 5 and spark.read.parquet(str(tmp_path / "obs")).count() == 400


def test_no_table_of_records_or_names_goes_through_the_driver(spark, tmp_path, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    planned, write, found = {}, R.cut, []
    monkeypatch.setattr(R, "CHUNK", 1)
    monkeypatch.setattr(R, "cut", lambda df, label: (planned.update({label: plan(df)}), write(df, label))[1])
    left, right = ([(i, f"{word} {i:04d}") for i in range(0, 400, step)] for word, step in (("Supplier", 37), ("Customer", 7)))
    sides = []
    for rows, key in ((left, "record_id"), (right, "company_id")):
        spark.createDataFrame(rows, f"{key} long, name string").write.parquet(f"{tmp_path}/{key}")  # a file's size is known
        sides.append(spark.read.parquet(f"{tmp_path}/{key}").select("*", *(F.lit(None).cast("string").alias(n) if n != "cin" else F.col(key).cast("string").alias(n) for n in R.SIGNALS if n != "name")))
    for sent, broadcasts in ((100_000, 1), (0, 0)):  # different trigrams alone, while they are few
        monkeypatch.setattr(R, "SENT", sent, raising=False)
        best = R.resolve(*sides)
        found.append(sorted(best.select("record_id", "company_id", "score").collect()))
        assert "BroadcastExchange" not in plan(best) and "BroadcastExchange" not in planned["similar"]
        decided = R.outcomes(best).select("record_id", "decision", "outcome", "new_company_id")
        assert "BroadcastExchange" not in plan(decided) and decided.filter("outcome = 'attach'").count() == 2
        counts = R.decision_counts(best, sides[1].filter("company_id % 9 = 0"))
        assert plan(counts).count("BroadcastExchange") == 1 and counts.first()[:] == (9, 2, 0, 0, 7)  # failures are sent as their number
        assert planned["trigrams"].count("BroadcastExchange") == broadcasts
    assert found[0] == found[1] and [(r.record_id, r.company_id, r.score) for r in found[0] if r.score == 1.0] == [(i, i, 1.0) for i, _ in left if i % 7 == 0]
