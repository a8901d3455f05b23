"""The five-record corpus of the fixtures."""

import datetime as dt

from tessera.model import SCHEMAS, Corpus


def at(day):
    return int(dt.datetime.fromisoformat(day + "T00:00:00+00:00").timestamp())


def make(spark, kev=True):
    def table(name, rows):
        return spark.createDataFrame(rows, SCHEMAS[name])

    def cve(i, name, year, state, cna, pub, upd, ver, score, sev, e=None, a=None, m=None):
        return (i, name, year, state, cna, at(pub), at(upd), ver, score, sev, None, None, e, a, m)

    entry = lambda c, i, r, added, due: (c, i, "v", "p", "n", "d", "a", added, at(added), due, at(due), r, None, [])
    return Corpus(
        cve=table("cve", [
            cve(1, "CVE-2021-44228", 2021, 1, 1, "2021-12-10", "2022-01-05", 31, 10.0, 4, 0, 0, 0),
            cve(2, "CVE-2022-0002", 2022, 1, 2, "2022-03-01", "2022-03-02", 30, 5.5, 2, 1, 1, 1),
            cve(3, "CVE-2023-0003", 2023, 2, 2, "2023-06-01", "2023-06-02", None, None, None),
            cve(4, "CVE-2024-0004", 2024, 1, 3, "2024-09-09", "2024-09-10", 4, 9.1, 4, 2, None, 1),
            cve(5, "CVE-2020-0005", 1999, 1, 3, "2020-02-02", "2020-02-03", 2, 3.0, 1),
        ]),
        cve_text=table("cve_text", [(1, "Remote code execution via JNDI lookup, a deserialization flaw in the logger", None, None), (2, "Cross-site scripting in the web console", None, None), (3, "Rejected: this candidate was withdrawn", None, None), (4, "Buffer overflow in the packet parser", None, None)]),
        cve_cwe=table("cve_cwe", [(1, 1), (2, 2), (4, 2)]),
        cve_ref=table("cve_ref", [(1, 1), (1, 2), (2, 3), (4, 2)]),
        cve_prod=table("cve_prod", [(1, 1, 1), (2, 2, None), (4, 3, 2), (4, 4, 3), (5, 2, None)]),
        cve_ver=table("cve_ver", [(1, 1, 1, "2.0", "2.15", None, None), (1, 1, 1, "2.0", "2.15", None, None)]),
        cna=table("cna", [(1, "Apache"), (2, "MITRE"), (3, "Cisco Systems")]),
        cwe=table("cwe", [(1, "CWE-502", "Deserialization"), (2, "CWE-79", "XSS")]),
        vendor=table("vendor", [(1, "Apache Software Foundation"), (2, "Cisco"), (3, "O'Reilly'); DROP TABLE cve; --")]),
        product=table("product", [(1, 1, "Log4j"), (2, 2, "IOS XE"), (3, 1, "Struts"), (4, 3, '"quoted" \\ product % _')]),
        host=table("host", [(1, "github.com"), (2, "nvd.nist.gov")]),
        url=table("url", [(1, "https://github.com/a", 1), (2, "https://nvd.nist.gov/b", 2), (3, "https://github.com/c", 1)]),
        vtype=table("vtype", []),
        kev=table("kev", [entry("CVE-2021-44228", 1, 1, "2021-12-10", "2021-12-24"), entry("CVE-2022-0002", 2, 0, "2022-03-25", "2022-04-15"), entry("CVE-2024-0004", 4, None, "2024-10-01", "2024-10-22"), entry("CVE-1999-0001", None, 0, "2022-03-25", "2022-04-15")]) if kev else None,
    )
