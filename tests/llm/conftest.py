import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="session")
def documents(spark):
    """A small corpus with the awkward cases: nulls, empties, ties, copies, near copies, one long text, clashing columns."""
    base = [f"w{k} of the corpus number {k % 7} says word{k * 3} and word{k * 5}" for k in range(40)]
    rows = [(k, "\n".join(base[(k * 3 + j) % 40] for j in range(4)), "en" if k % 2 else "de", f"s{k % 3}") for k in range(30)]
    rows += [(100 + k, rows[k][1], "en", "s0") for k in range(5)]  # exact copies
    rows += [(110 + k, rows[k][1].replace("says", "said", 1), "en", "s1") for k in range(5)]  # near copies
    rows += [(200, None, None, None), (201, "", "en", None), (202, "   \n\t\n", "fr", "s2"), (203, "one", "en", "s2"), (204, "Two Words", "en", "é")]
    rows += [(205, " ".join(f"long{k % 977}" for k in range(20_000)), "en", "s2"), (206, "x" * 50_000, "en", "s2"), (207, "naïve café ☕ naïve", "fr", "s1")]
    rows += [(3, rows[3][1], rows[3][2], rows[3][3])]  # a repeated row
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr("*", "length(text) AS n_chars", "1 AS size", "'x' AS bucket", "2 AS level")
