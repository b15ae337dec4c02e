"""Unit vectors of the string, HTML, matching and classifier rules."""

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators import classify, dedup, html_items, quality


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, letter, short, explanation",
    [
        ("b) Foo (correcta): because", "b.", "Foo", "because"),
        ("Foo (Incorrecta): a: b", "d.", "Foo", "a: b"),
        ("a) Foo: bar: baz", "a.", "Foo", "bar: baz"),
        ("Foo (correcta)", "d.", "Foo", ""),
        ("Foo", "d.", "Foo", ""),
        ("f) Foo", "d.", "f) Foo", ""),
    ],
)
def test_option(spark, raw, letter, short, explanation):
    option = value(spark, text.parse_option(F.lit(raw), F.lit(3), F.lit(True)))
    assert (option.letter, option.text, option.explanation) == (letter, short, explanation)


@pytest.mark.parametrize(
    "given, wanted",
    [("FooFoo", "Foo"), ("Fooa)Foo", "Foo"), ("Foo Foo", "Foo"), ("Foo Bar", "Foo Bar"), ("", ""), ("ññ", "ñ")],
)
def test_repeated_text(spark, given, wanted):
    assert value(spark, text.drop_repeated_text(F.lit(given))) == wanted


@pytest.mark.parametrize(
    "url, name",
    [
        ("http://h/a/b.png?x=1", "q_1_2.png"),
        ("http://h/a/b", "q_1_2.jpg"),
        ("http://h/a/b.tar.gz#f", "q_1_2.gz"),
        ("http://h/a/.png", "q_1_2.jpg"),
        ("/a/b.jpeg;v=1", "q_1_2.jpeg"),
        ("http://h.x", "q_1_2.jpg"),
    ],
)
def test_storage_name(spark, url, name):
    assert value(spark, text.storage_name(F.lit("q/1"), F.lit(2), F.lit(url))) == name


def test_identifiers_and_keys(spark):
    assert value(spark, text.safe_identifier(F.lower(F.lit("Agosto 2021")))) == "agosto_2021"
    assert value(spark, text.strip(F.lit("  a b\t\n\x1f"))) == "a b"
    long = "  AB" + "x" * 96 + "tail"
    assert value(spark, text.prefix_key(F.lit(long))) == "ab" + "x" * 96


@pytest.mark.parametrize(
    "sentence, answer",
    [
        ("La respuesta correcta es: Foo", "Foo"),
        ("LA RESPUESTA CORRECTA:  Foo", "Foo"),
        ("Respuesta correcta", ""),
        ("Foo", ""),
    ],
)
def test_stated_answer(spark, sentence, answer):
    assert value(spark, text.stated_answer(F.lit(sentence))) == answer


@pytest.mark.parametrize(
    "stated, options, hit",
    [
        ("aspirin 100 mg", ["ibuprofen", "aspirin"], 1),
        ("Aspirin", ["aspirin forte", "aspirin"], 0),
        ("uno dos tres cinco", ["", "uno  dos tres cuatro"], 1),
        ("nada", ["", "otra"], None),
        ("", ["a"], None),
    ],
)
def test_answer_match(spark, stated, options, hit):
    built = F.array(
        *[
            F.struct(
                F.lit("x.").alias("letter"), F.lit(o).alias("text"), F.lit("").alias("explanation"),
                F.lit(False).alias("is_correct"),
            )
            for o in options
        ]
    )
    items = spark.range(1).select(built.alias("answer_options"), F.lit(stated).alias("stated_answer"))
    row = html_items.match_stated_answer(items).first()
    assert [o.is_correct for o in row.answer_options] == [i == hit for i in range(len(options))]
    assert row.unmatched == (hit is None and stated != "")


CLASSIFIED = [
    ('{"category": "Diabetes", "confidence": 0.8}', "Diabetes", 0.8),
    ('{"category": "Diabetes"}', "Diabetes", 0.5),
    ('```json\n{"category": "Diabetes", "confidence": "0.7"}\n```', "Diabetes", 0.7),
    ('```\n{"category": "Diabetes", "confidence": 0.7}', "Diabetes", 0.7),
    ('{"category": "La diabetes mellitus", "confidence": 0.5}', "Diabetes", 0.45),
    ('{"category": "Otra", "note": "urología"}', "Urología", 0.5),
    ('{"category": "Otra"}', "Medicina Legal", 0.3),
    ("Creo que PEDIATRÍA o Urología", "Urología", 0.5),
    ("No sé", "Medicina Legal", 0.3),
    ("[1]", "Medicina Legal", 0.1),
    ('{"category": null}', "Medicina Legal", 0.1),
    ('{"category": 3}', "Medicina Legal", 0.1),
    ('{"category": "Diabetes", "confidence": "alta"}', "Medicina Legal", 0.1),
    (None, "Medicina Legal", 0.1),
]


def test_classifier_answers(spark):
    frame = spark.createDataFrame(
        [(i, r) for i, (r, _, _) in enumerate(CLASSIFIED)], "question_id bigint, response string"
    )
    found = {r.question_id: (r.category, round(r.confidence, 6)) for r in classify.parse_responses(frame).collect()}
    assert found == {i: (c, p) for i, (_, c, p) in enumerate(CLASSIFIED)}


def codes(spark, check, json):
    raw = spark.createDataFrame([("x", json)], "question_id string, json string")
    return sorted((i.code, i.path) for i in check(raw).first().issues)


OPTION = '{"letter":"a.","text":"t","is_correct":true}'
GOOD = (
    '{"question_id":"1","question_number":"1","topic":"t","question_text":"q","answer_options":[%s],'
    '"correct_answer":"a","explanation":"","images":[],"source_file":"f","source_type":"s"}'
)


@pytest.mark.parametrize("check", [quality.check_for_import, quality.check_strictly])
def test_good_question(spark, check):
    assert codes(spark, check, GOOD % OPTION) == []


def test_defects(spark):
    imports, strict = quality.check_for_import, quality.check_strictly
    assert codes(spark, imports, "no json") == [("not_an_object", "")]
    assert codes(spark, imports, "[1]") == [("not_an_object", "")]
    assert codes(spark, imports, GOOD % "1") == [
        ("no_correct_option", "answer_options"),
        ("option_not_object", "answer_options[0]"),
    ]
    twice = (GOOD % f"{OPTION},{OPTION}").replace('"topic":"t"', '"topic":" "')
    assert codes(spark, imports, twice) == [("empty_topic", "topic"), ("many_correct_options", "answer_options")]
    assert codes(spark, strict, twice) == [("many_correct_options", "answer_options")]
    typed = (GOOD % OPTION).replace('"images":[]', '"images":"x","reconstruction_name":1,"reconstruction_order":"2"')
    assert codes(spark, imports, typed) == [
        ("exam_name_not_string", "reconstruction_name"),
        ("exam_order_not_integer", "reconstruction_order"),
        ("images_not_list", "images"),
    ]
    half = (GOOD % OPTION).replace('"images":[]', '"images":[1],"reconstruction_name":"e"')
    assert codes(spark, strict, half) == [
        ("exam_fields_not_both", "reconstruction_name"),
        ("image_not_string", "images[0]"),
    ]
    null = (GOOD % OPTION).replace('"explanation":""', '"explanation":null')
    assert codes(spark, imports, null) == []
    missing = (GOOD % OPTION).replace('"explanation":"",', "")
    assert codes(spark, imports, missing) == [("field_missing", "explanation")]


def test_checks_stop(spark):
    frame = spark.createDataFrame(
        [("a", 0, "f"), ("a", 1, "g")], "question_id string, ordinal bigint, source_file string"
    )
    with pytest.raises(quality.CheckFailed, match="first_source"):
        quality.require_none(dedup.duplicate_report(frame), "duplicates")
    with pytest.raises(quality.CheckFailed):
        quality.require_count(frame, 3, "rows")
    with pytest.raises(quality.CheckFailed):
        quality.require_rows(frame.limit(0), "rows")
