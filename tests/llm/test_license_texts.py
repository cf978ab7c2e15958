"""Whole licence texts, where the machine has them, are named rightly or not at all; notices by their version."""

from pathlib import Path

import pytest

from repolytics.llm import licenses

FOLDER = Path("/usr/share/common-licenses")
RIGHT = {
    "Apache-2.0": "apache-2.0", "Artistic": "artistic-1.0", "BSD": "bsd", "CC0-1.0": "cc0-1.0", "GFDL-1.2": "gfdl-1.2", "GFDL-1.3": "gfdl-1.3", "GPL-1": "gpl-1.0", "GPL-2": "gpl-2.0", "GPL-3": "gpl-3.0",
    "LGPL-2": "lgpl-2.0", "LGPL-2.1": "lgpl-2.1", "LGPL-3": "lgpl-3.0", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2.0",
}


@pytest.mark.parametrize("name", RIGHT)
def test_whole_texts(name):
    if not (FOLDER / name).exists():
        pytest.skip("this machine doesn't hold the text")
    found = dict(licenses.Matcher().text((FOLDER / name).read_text()))
    found.pop(licenses.RESERVED, None)
    assert set(found) == {RIGHT[name]}


@pytest.mark.parametrize("version", ["1", "2", "3"])
def test_notices_by_version(version):
    gpl = licenses._GPL.format(version)
    assert [n for n, _ in licenses.Matcher().text(f"/*\n{gpl}\n*/")] == [f"gpl-{version}.0"]


def test_a_reserved_right_is_second_to_a_licence(spark):
    texts = ["All rights reserved.", "All rights reserved.\n\nReleased under the MIT License.", None, ""]
    rows = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r.license, r.n_licenses) for r in rows] == [(licenses.RESERVED, 1), ("mit", 2), (None, 0), (None, 0)]
