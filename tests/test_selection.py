import re

import pytest

from orrery.functions.selection import SelectionError, glob_regex, parse, range_list, select


def matches(glob, text):
    return re.fullmatch(glob_regex(glob), text) is not None


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("C*", ["C", "CA", "CB1"], ["NC", ""]),
        ("C?", ["CA"], ["C", "CAB"]),
        ("[CN]A", ["CA", "NA"], ["OA"]),
        ("[!H]*", ["CA", "N"], ["H", "HB"]),
        ("@(CA|CB)", ["CA", "CB"], ["C", "CAB"]),
        ("?(A)B", ["B", "AB"], ["AAB"]),
        ("+(AB)", ["AB", "ABAB"], ["", "A"]),
        ("*(AB)C", ["C", "ABC"], ["AC"]),
        ("!(CA|CB)", ["C", "CAB", "N"], ["CA", "CB"]),
        ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_globs(glob, yes, no):
    assert all(matches(glob, t) for t in yes)
    assert not any(matches(glob, t) for t in no)


def test_ranges():
    assert range_list("@(1-5|10)") == [1, 2, 3, 4, 5, 10]
    assert range_list("7,9;11-12") == [7, 9, 11, 12]
    with pytest.raises(SelectionError):
        range_list("5-1")
    with pytest.raises(SelectionError):
        parse("/a/b/c/d/e")
    assert parse("/CA")[0].fields == ("*", "*", "*", "CA")
    assert parse("/A/*/1-3/CA ; del /A/*/2/*")[1].verb == "del"


@pytest.fixture(scope="module")
def chain(spark):
    rows = [(k, "A" if k <= 6 else "B", "S", (k - 1) // 3 + 1, ["N", "CA", "C"][(k - 1) % 3], float(k), 0.0, 0.0) for k in range(1, 13)]
    return spark.createDataFrame(rows, "atom_id int, chain_id string, seg_id string, res_seq int, atom_name string, x double, y double, z double")


def ids(rows):
    return sorted(r["atom_id"] for r in rows.collect())


def test_select(chain):
    assert ids(select(chain, "/CA")) == [2, 5, 8, 11]
    assert ids(select(chain, "/A/*/*/C*")) == [2, 3, 5, 6]
    assert ids(select(chain, "/*/*/@(1-2|4)/CA")) == [2, 5, 11]
    assert ids(select(chain, "/CA ; del /B/*/*/* ; add /*/*/4/N")) == [2, 5, 10]
    assert ids(select(chain, "/#")) == [2, 5, 8, 11]


def test_select_by_distance(chain):
    assert ids(select(chain, "/A/*/1/CA[1.0]")) == [1, 2, 3]
    assert ids(select(chain, "/A/*/1/CA[-9.0]")) == [11, 12]
    assert ids(select(chain, "/A/*/1/CA[1.5] ; del /N")) == [2, 3]
