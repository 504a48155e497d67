"""License scans: short notices one after another are one match each."""

from marlstone.llm import licenses


def test_consecutive_short_notices(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    texts = [f"{mit}\n" * 7, f"{mit} and {mit} x y z {mit}", f"{cc} {cc} {mit} {mit}", f"{mit} Released under an MIT License. {mit}"]
    for r in licenses.scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        starts = sorted([k for k in range(len(r.text)) if r.text.startswith(("Released", "Licensed"), k)])
        assert [m.start for m in r.licenses] == starts
        assert all(r.text[m.start : m.end].endswith(("License", "4.0")) for m in r.licenses)


def test_many_consecutive_notices_take_time_in_proportion():
    index = licenses.Index(licenses.TEMPLATES)
    words = index.words[index.names.index("MIT-line")].tolist() * 2000
    import numpy as np

    assert len(licenses._matches(index, np.array(words, np.uint64), 0.8)) == 2000
