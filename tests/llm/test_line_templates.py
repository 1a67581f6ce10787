from __future__ import annotations

from tests.llm.helpers import sentences, table
from threadlab.llm import line_templates

LETTERS = str.maketrans("0123456789", "abcdefghij")


def dropped(spark, rows):
    return {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(table(spark, rows)).collect()}


def test_copies_do_not_protect_a_line(spark):
    line = "All rights reserved by the owners."
    rows = [(i, f"{sentences(2, i)}\n{line}") for i in range(20)]
    rows += [(1000 + i, f"{sentences(2, 'copied')}\n{line}") for i in range(300)]
    got = dropped(spark, rows)
    assert set(got.values()) == {1} and len(got) == 320


def test_documents_made_of_templates_only(spark):
    rows = [(i, f"job {i} was started\ndisk use is {i} percent now\nuser u{i} has logged out") for i in range(40)]
    assert set(dropped(spark, rows).values()) == {3}


def test_origin_does_not_depend_on_the_leaf_of_the_line(spark):
    lines = [f"{a} {b} {c}" for a in "abcd" for b in "efgh" for c in "ijk"]  # some leaves are below those of the texts
    rows = [(i, "\n".join([sentences(12, f"own{i}-{k}") for k in range(8)] + lines)) for i in range(6)]
    assert set(dropped(spark, rows).values()) == {len(lines)}


def test_constants_do_not_depend_on_how_full_the_leaf_is(spark):
    rows = [(i, f"{sentences(2, i)}\nRead more about our terms of use") for i in range(20)]
    rows += [(100 + i, f"Read more about {' '.join(f'{i:04d}{k}'.translate(LETTERS) for k in range(4))}") for i in range(2500)]
    got = dropped(spark, rows)
    assert [got[i] for i in range(20)] == [1] * 20 and sum(got.values()) == 20


def test_fields_whose_values_recur(spark):
    rows = [(i, f"{sentences(2, i)}\nPosted on day {i % 19} of month {i % 17} by the team of editor e{i % 23}") for i in range(400)]
    assert set(dropped(spark, rows).values()) == {1}


def test_short_lines_with_fields(spark):
    rows = [(i, f"{sentences(2, i)}\nviews: {7 * i} likes: {i}\nTotal {i}") for i in range(40)]
    assert set(dropped(spark, rows).values()) == {1}  # one constant is no template


def test_one_of_a_family_of_near_copies_stays_whole(spark):
    body = [sentences(1, f"body{k}") for k in range(20)]
    rows = [(10 + i, "\n".join([*body, sentences(1, f"last{i}")])) for i in range(6)]
    rows += [(100 + i, "\n".join([*body, sentences(1, f"late{i}")][i % 3:])) for i in range(300)]  # many, not all alike
    rows += [(500 + i, f"{sentences(9, f'own{i}')}\nAll rights reserved by the owners.") for i in range(20)]
    rows += [(600, "All rights reserved by the owners."), (601, "\n".join(body[:2]))]
    for some in (rows[:6], rows):
        got = {r.doc_id: r for r in line_templates.drop_recurring(table(spark, some)).collect()}
        whole = [i for i, text in some if got[i].n_dropped == 0 and i < 500]
        assert 10 in whole and len(whole) <= 4 and got[10].text == rows[0][1]
        assert all(got[i].n_dropped >= 18 for i, _ in some if i < 500 and i not in whole)
        assert all(got[i].n_dropped == 1 for i, _ in some if 500 <= i <= 600)


def test_families_with_null_ids_and_repeated_rows(spark):
    body = [sentences(1, f"body{k}") for k in range(9)]
    rows = [(None, "\n".join([*body, sentences(1, f"last{i}")])) for i in range(6)] * 2
    got = line_templates.drop_recurring(table(spark, rows)).collect()
    assert sorted(r.n_dropped for r in got) == [0] * 2 + [9] * 10


def test_pages_of_templates_are_no_family(spark):
    rows = [(i, "\n".join(f"{w} {i} of {k} was seen" for k, w in enumerate("abcdef"))) for i in range(30)]
    assert set(dropped(spark, rows).values()) == {6}
