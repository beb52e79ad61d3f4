"""License scans against DuckDB, by planted variants and wraps, and on awkward rows."""

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import SF, awkward, empty
from tests.oracle import actual, expected

from rillspark.llm import contracts, licenses

TEXTS = {name: text for name, _, text in reversed(licenses.TEXTS)}
LONG = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")


def test_op1_matches_sql(spark):
    assert actual(contracts.op1_license_digests(spark, SF)) == expected(SF, licenses.sql())


def found(spark, texts):
    rows = licenses.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r for r in rows}


def test_variants_of_whole_texts(spark):
    mit = "MIT License\n\nCopyright (c) <year> <holder>\n\n" + TEXTS["MIT"]
    rows = [
        mit, mit.upper().replace("\n", "  \n"), mit.replace("(c) <year> <holder>", "2020 Some One\n(C) 2021 Another"), "/* " + mit.replace('"', "“").replace(",", " ,") + " */", mit + " and more",
        TEXTS["ISC"].replace("LICENSE", "licence").replace("License", "Licence"), TEXTS["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "- "), "some text\nReleased under the MIT Licence\nmore", None, "©",
        TEXTS["BSD-3-Clause"].replace("copyright holder", "copyright\nowner").replace("1.", "a)"), "x\n" + TEXTS["WTFPL"].replace("\n", " "),
    ]
    got = found(spark, rows)
    assert [got[i].license for i in range(len(rows))] == ["MIT", "MIT", "MIT", "MIT", None, "ISC", "BSD-2-Clause", None, None, None, None, None]
    assert (got[7].notice_lines, got[7].notice_licenses) == (1, "MIT") and (got[11].notice_lines, got[11].notice_licenses) == (1, "WTFPL")


def test_every_known_text_at_any_wrap(spark, tmp_path):
    """Short and long texts, wrapped anew at several widths under a copyright line, by the operator and by its SQL."""
    rows, sign = [], re.compile(r"^\W*copyright\W*([(]c[)]|<|\[|[0-9]{4})", re.IGNORECASE | re.MULTILINE)
    for name, text in licenses.known_texts():
        if (name, text) in licenses.NOTICES:
            continue
        for width in (40, 72, 79, 100):
            # paragraphs with a copyright line of their own stay as they are
            body = "\n\n".join(p if sign.search(p) else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
            rows.append((name, f"Copyright (c) 2019, 2021 Some One <one@example.org>\nAll rights reserved.\n\n{body}\n"))
    got = found(spark, [t for _, t in rows])
    assert {(n, got[i].license) for i, (n, _) in enumerate(rows)} == {(n, n) for n, _ in rows} and set(LONG) <= {n for n, _ in rows}
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert actual(licenses.report(spark.read.parquet(f"{tmp_path}/documents.parquet"))) == expected(str(tmp_path), licenses.sql().replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))


@pytest.mark.parametrize("line", ["copyright notice and this permission notice appear in all copies.", "Copyright holders shall not be liable", "copyright license to reproduce"])
def test_prose_is_no_copyright_line(spark, line):
    assert spark.range(1).select(licenses.canonical(F.lit(f"a\n{line}\nb"))).first()[0].startswith("a copyright ")


def test_form_of_lines_is_that_of_the_whole(spark):
    """The form put together from lines against all replacements one after the other."""
    rng = random.Random(3)
    words = [w for pair in licenses.EQUIVALENT for side in pair for w in side.split()] + ["a", "(c) 2020 x", "copyright 1999", "é", "--", "non", "sub", "per"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "\n\n", "\t"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    plain = F.regexp_replace(F.regexp_replace(F.lower("text"), "(?md)" + licenses.COPYRIGHT, " "), r"[^\p{L}\p{N}]+", " ")
    for old, new in licenses.EQUIVALENT:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(F.trim(plain) != licenses.canonical(F.col("text"))).count() == 0


def test_awkward(spark):
    rows = licenses.report(awkward(spark)).collect()
    assert len(rows) == 9 and all(r.license is None and r.notice_lines == 0 for r in rows)
    assert licenses.report(empty(spark)).count() == 0
