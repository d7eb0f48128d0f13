"""Large rule files: read rule by rule, with the rows that a YAML reader gives."""

import tracemalloc

import pytest

from shorewatch.sources.rule_files import rules_from_folders
from shorewatch.sources.rules import RuleError, listed_rules, parse_rules
from shorewatch.sources import trees

ALIKE = [
    "[]", " [ ] \n", '[{"id":"a"},{"id":"b","extensions":[".x"],"composition":true}]', '[{"id": 7, "id": 8}]\n', '[{"id":"a\\/b\\u00e9\\n"}]',
    '[{"id":1.50}]', '[{"id":1e5}]', '[{"id":NaN}]', '[{"id":null}]', "- id: a\n- id: b\n", "", "# none", '[{"id":"  \x85 x"}]', '[{"id":"é😀"}]', "[{id: a}]", '[{"id":"a"},]',
]
REFUSED = ["{}", "3", '["a"]', '[{"id":"a"},3]', '[{"id":"a"}] x', '[{"id":"a"}', '[{"id":"a"}]\n---\n[]', '[{"id":"a","extensions":5}]', '[\t{"id":"a"}]', '[{"id":"\x7f"}]', "[,]"]


@pytest.mark.parametrize("text", ALIKE)
def test_same_rules_as_of_the_yaml_reader(text):
    assert list(listed_rules(text)) == parse_rules(text)


@pytest.mark.parametrize("text", REFUSED)
def test_a_bad_document_is_refused_before_its_first_rule(text):
    with pytest.raises(Exception) as want:
        parse_rules(text)
    with pytest.raises(type(want.value)):
        listed_rules(text)


def test_rules_are_not_held_together():
    text = "[" + ",".join(f'{{"id":"r{i}","pattern":"p{i}","message":"{"m" * 50}"}}' for i in range(20_000)) + "]"
    tracemalloc.start()
    try:
        assert sum(1 for _ in listed_rules(text)) == 20_000
        assert tracemalloc.get_traced_memory()[1] < len(text)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("mode", [trees.PERMISSIVE, trees.DROPMALFORMED, trees.FAILFAST])
def test_rows_leave_in_their_order(spark, tmp_path, monkeypatch, mode):
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", 3)
    (tmp_path / "a.yaml").write_text("[" + ",".join(f'{{"id":"r{i}"}}' for i in range(7)) + "]")
    (tmp_path / "b.yml").write_text("- id: x\n- id: y\n")
    if mode != trees.FAILFAST:
        (tmp_path / "c.yaml").write_text('[{"id":"lost"},3]')
    rows = rules_from_folders(spark, str(tmp_path), mode=mode).collect()
    assert sorted((r.file, r.pos, r.id) for r in rows if r.problem is None) == [*[("a.yaml", i, f"r{i}") for i in range(7)], ("b.yml", 0, "x"), ("b.yml", 1, "y")]
    assert [r.file for r in rows if r.problem is not None] == (["c.yaml"] if mode == trees.PERMISSIVE else [])


def test_a_refused_file_fails_the_job(spark, tmp_path):
    (tmp_path / "c.yaml").write_text('[{"id":"lost"},3]')
    with pytest.raises(Exception, match="expected a list of rules"):
        rules_from_folders(spark, str(tmp_path)).collect()
    with pytest.raises(RuleError):
        listed_rules('[{"id":"lost"},3]')
