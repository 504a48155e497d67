"""License scans: the third clause tells BSD-3-Clause from BSD-2-Clause."""

from marlstone.llm import licenses


def test_bsd_clauses():
    index = licenses.Index(licenses.TEMPLATES)
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        found = licenses._matches(index, index.words[index.names.index(name)], 0.8)
        assert [index.names[k] for k, *_ in found] == [name]


def test_a_text_of_two_clauses_is_no_bsd_3(spark):
    two = dict(licenses.TEMPLATES)["BSD-3-Clause"].split("Neither the name")[0]
    got = licenses.scan_licenses(spark.createDataFrame([(two,)], "text string")).first()
    assert [m.license for m in got.licenses] == ["BSD-2-Clause"]
