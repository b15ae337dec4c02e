import json

import pytest

from recallgrid.operators.quality import CheckFailed
from recallgrid.sources import readers

QUESTION = {"question_id": "a", "question_text": "one"}


@pytest.mark.parametrize(
    "content, what",
    [
        (json.dumps(QUESTION), "OBJECT"),
        (json.dumps([QUESTION, QUESTION])[:-9], "broken"),
        ("3", "BIGINT|SMALLINT|TINYINT|INT|DECIMAL"),
    ],
)
def test_only_lists_are_question_files(spark, tmp_path, content, what):
    (tmp_path / "good.json").write_text(json.dumps([QUESTION]))
    (tmp_path / "bad.json").write_text(content)
    assert [r.question_id for r in readers.read_questions_json(spark, str(tmp_path / "good.json")).collect()] == ["a"]
    for read in (readers.read_questions_json, readers.read_raw_questions):
        with pytest.raises(CheckFailed, match="bad.json"):
            read(spark, str(tmp_path))


def test_broken_lines(spark, tmp_path):
    lines = json.dumps(QUESTION)
    (tmp_path / "good.json").write_text(f"{lines}\n\n{lines}\n")
    assert readers.read_questions_json(spark, str(tmp_path / "good.json"), lines=True).count() == 2
    for bad in (f"{lines}\n{lines[:-4]}\n", f"[{lines}]\n", f"{lines}\n7\n"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(CheckFailed, match="bad.json"):
            readers.read_questions_json(spark, str(tmp_path / "bad.json"), lines=True)
