import pytest

from tessera.model import NOT_ASSESSED, CatalogMissing
from tessera.operators import reports as R
from tessera.operators import search
from tessera.operators.dims import DIMS
from tessera.operators.filters import Filters, matching, uses_kev

from .corpus import at, make

ALL = {"state": "all"}


@pytest.fixture(scope="module")
def corpus(spark):
    return make(spark)


def ids(corpus, **f):
    return {r.id for r in matching(corpus, Filters(**f)).collect()}


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({}, {1, 2, 4, 5}), ({"state": "rejected"}, {3}), (ALL, {1, 2, 3, 4, 5}), ({"state": "?"}, {1, 2, 4, 5}),
        ({"text": "deserialization"}, {1}), ({"text": "overflow"}, {4}), ({"text": "cross-site scripting"}, {2}), ({"text": '"packet parser"'}, {4}), ({"text": "parse*"}, {4}), ({"text": "!!!"}, set()),
        ({"cve_id": "cve-2021-44228"}, {1}), ({"vendor": ["Apache Software Foundation"]}, {1, 4}), ({"product": ["ios xe"]}, {2, 5}), ({"vendor": ["nobody"]}, set()), ({"vendor": ["Cisco", "nobody"]}, {2, 5}), ({"vendor": ["O'Reilly'); DROP TABLE cve; --"]}, {4}),
        ({"cwe": ["CWE-79"]}, {2, 4}), ({"cwe": ["79"]}, {2, 4}), ({"host": ["github.com"]}, {1, 2}), ({"host": ["nvd.nist.gov"]}, {1, 4}),
        ({"severity": [4]}, {1, 4}), ({"cvss_version": [4]}, {4}), ({"cvss_version": [30, 31]}, {1, 2}), ({"score_min": 9}, {1, 4}), ({"score_min": 3, "score_max": 5.5}, {2, 5}),
        ({"published_from": at("2022-01-01")}, {2, 4}), ({"published_to": at("2021-12-31")}, {1, 5}), ({"year_from": 2022, "year_to": 2024}, {2, 4}),
        ({"kev": [1], **ALL}, {1, 2, 4}), ({"kev": [0], **ALL}, {3, 5}), ({"kev": [0, 1], **ALL}, {1, 2, 3, 4, 5}), ({"kev": [7]}, set()), ({"kev_ransomware": [NOT_ASSESSED]}, {4}), ({"kev_added_from": at("2024-01-01")}, {4}), ({"kev_added_from": at("2021-01-01"), "kev_added_to": at("2022-12-31")}, {1, 2}),
        ({"ssvc_auto": [NOT_ASSESSED], **ALL}, {3, 4, 5}),
    ],
)
def test_filters(corpus, filters, want):
    assert ids(corpus, **filters) == want


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_groups(corpus):
    assert [r[::2] for r in cells(R.group(corpus, Filters(severity=[4]), "year"))] == [("2021", 1), ("2024", 1)]
    weeks = [r[0] for r in cells(R.group(corpus, Filters(), "week"))]
    assert "2021-12-06" in weeks and "2022-02-28" in weeks
    years = [r[0] for r in cells(R.group(corpus, Filters(), "year"))]
    assert "2020" in years and "1999" not in years
    assert [r[0] for r in cells(R.group(corpus, Filters(), "cvssVersion"))] == [2, 30, 31, 4]
    assert [r[::2] for r in cells(R.group(corpus, Filters(**ALL), "ssvcExpl"))] == [(0, 1), (1, 1), (2, 1), (None, 2)]
    assert [r[::2] for r in cells(R.group(corpus, Filters(**ALL), "ssvcAuto"))][-1] == (None, 3)
    assert [r[::2] for r in cells(R.group(corpus, Filters(**ALL), "kevRansomware"))] == [(1, 1), (0, 1), (2, 2), (None, 1)]
    assert [r[0] for r in cells(R.group(corpus, Filters(**ALL), "state"))] == [2, 1]
    cut = [r[0] for r in cells(R.group(corpus, Filters(**ALL), "year", 2))]
    assert cut == ["2023", "2024", "2022"]  # the two latest, then the row too many


def test_every_axis_alone_and_every_pair_runs(corpus):
    for a in DIMS:
        assert R.group(corpus, Filters(**ALL), a).columns == ["bucket", "label", "cves"]
        for b in DIMS:
            if a != b:
                assert R.cross(corpus, Filters(**ALL), a, b).columns == ["bucket", "label", "series", "series_label", "cves"]


def test_cross_tabs(corpus):
    got = cells(R.cross(corpus, Filters(**ALL), "year", "severity"))
    assert [r for r in got if r[2] is None] == [("2023", "2023", None, None, 1)]
    assert sum(r[4] for r in cells(R.cross(corpus, Filters(), "vendor", "severity")) if r[1].startswith("Apache")) == 2
    pairs = cells(R.cross(corpus, Filters(), "vendor", "product"))
    assert pairs and all(r[3].startswith(r[1] + " / ") for r in pairs)
    with pytest.raises(ValueError):
        R.cross(corpus, Filters(), "year", "year")
    with pytest.raises(ValueError):
        R.group(corpus, Filters(), "nothing")


def test_missing_catalog_is_refused(spark):
    bare = make(spark, kev=False)
    for f in (Filters(kev=[1]), Filters(kev_due_to=1.0), Filters(kev_ransomware=[2])):
        assert uses_kev(f)
        with pytest.raises(CatalogMissing):
            matching(bare, f)
    with pytest.raises(CatalogMissing):
        R.group(bare, Filters(), "kev")


def test_limits():
    assert R.clamp(10**9, 500, 5000) == 5000 and R.clamp("x", 500, 5000) == 500 and R.clamp(0, 500, 5000) == 500 and R.clamp(float("inf"), 5, 9) == 5
    assert R.clamp_offset(10**12) == 1_000_000 and R.clamp_offset(-3) == 0


def test_detail(corpus):
    parts = R.detail(corpus, " cve-2021-44228 ")
    assert parts["record"].first().cna == "Apache" and parts["versions"].count() == 2
    assert [r.host for r in parts["refs"].collect()] == ["github.com", "nvd.nist.gov"]
    assert parts["kev"].first().ransomware == 1 and R.detail(corpus, "CVE-1-1")["exists"].count() == 0
    rows, cut = R.cut_off(R.rows(corpus, Filters(), 2), 2)
    assert [r.cve for r in rows] == ["CVE-2024-0004", "CVE-2022-0002"] and cut


def test_search_terms():
    assert search.parse("!!! -") is None
    assert [t.words for t in search.parse('Cross-site "packet parser" über*')] == [("cross", "site"), ("packet", "parser"), ("uber",)]
    assert search.parse("a*")[0].prefix and len(search.ACCENTED) == len(search.PLAIN)


def test_a_part_of_a_detail_asks_for_its_tables_only(corpus):
    def never():
        raise AssertionError("a table of another part was asked for")

    c = corpus.having(cve_text=never, cve_prod=never, cve_ver=never, cve_ref=never, kev=never)
    assert [r.cwe for r in R.detail(c, "CVE-2021-44228", ("cwes",))["cwes"].collect()] == ["CWE-502"]


def test_a_part_of_a_search_asks_for_its_own_tables(spark):
    def never():
        raise AssertionError("asked for")

    c = make(spark).having(**{n: never for n in ("cve", "cve_text", "cve_prod", "product", "cna")})
    found = R.search(c, Filters(vendor=["Cisco", "nobody"]), counted=False)
    assert [r.name_key for r in found.unmatched["vendor"].collect()] == ["nobody"] and found.matches is None
    with pytest.raises(AssertionError):
        found.rows  # noqa: B018


def test_names_that_nothing_has_read_no_links(spark):
    def never():
        raise AssertionError("asked for")

    c = make(spark).having(**{n: never for n in ("cve_text", "cve_prod", "cve_cwe", "cve_ref", "product", "url")})
    assert matching(c, Filters(vendor=["nobody"])).count() == matching(c, Filters(vendor=["Cisco"], cwe=["CWE-1"], text="web")).count() == 0
    assert matching(c, Filters(cna=["MITRE"], state="all")).count() == 2
