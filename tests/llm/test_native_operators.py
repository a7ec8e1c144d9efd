"""Operators made of DataFrame functions only: tool calls and surrogates."""

import json
import re

import pytest

from hrefmill.llm import surrogates, tool_calls

TOOLS = {"f": {"x": ("integer", True), "y": ("string", False)}}
MESSAGES = "conv_id long, turn long, role string, text string"


def placing(*calls):
    return json.dumps({"tool_calls": list(calls)})


def linked(spark, rows):
    found = tool_calls.link(spark.createDataFrame(rows, MESSAGES), TOOLS)
    return {(r["conv_id"], r["turn"], r["place"]): r for r in found.collect()}


def test_tool_calls(spark):
    got = linked(
        spark,
        [
            (1, 0, "user", "hi"),
            (1, 1, "assistant", placing(
                {"id": "a", "name": "f", "arguments": {"x": 1}, "depends_on": ["b"]},
                {"id": "b", "name": "f", "arguments": '{"y": "s", "x": 2.5}'},
            )),
            (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": 2}})),
            (1, 3, "tool", json.dumps({"tool_call_id": "lost"})),
            (2, 0, "assistant", placing(
                {"id": "a", "name": "f", "arguments": {"x": 1}, "depends_on": ["b"]},
                {"id": "b", "name": "g", "arguments": [1], "depends_on": ["a"]},
                {"name": "f", "arguments": [1]},
                {"id": "a", "name": "f", "arguments": {"x": 1, "q": 2}},
                {"id": "c", "name": "f", "arguments": {}, "depends_on": ["gone"]},
            )),
            (3, 0, "tool", ""),
        ],
    )
    assert (got[1, 1, 0]["level"], got[1, 1, 1]["level"]) == (1, 0)
    assert got[1, 1, 0]["linked"] and not got[1, 1, 1]["linked"] and got[1, 2, 0]["linked"]
    assert got[1, 1, 1]["errors"] == ["type of x"] and got[1, 3, 0]["errors"] == ["no call"]
    assert got[1, 2, 0]["json"] == '{"content":{"b":2,"z":1},"tool_call_id":"a"}'
    assert got[1, 1, 1]["json"] == '{"arguments":{"x":2.5,"y":"s"},"depends_on":[],"id":"b","name":"f"}'
    assert got[2, 0, 0]["errors"] == ["cyclic"] and got[2, 0, 0]["level"] is None
    assert got[2, 0, 1]["errors"] == ["unknown tool", "cyclic"]
    assert got[2, 0, 2]["errors"] == ["arguments are no object", "no id"]
    assert got[2, 0, 3]["errors"][:2] == ["unknown q", "repeated id"]
    assert got[2, 0, 4]["errors"] == ["missing x", "unknown call gone"]
    assert got[3, 0, 0]["kind"] == "text"


def test_tool_calls_edge_cases(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", placing({"id": "a", "name": "f", "arguments": {"x": 1}}))]
    rows += [(None, 2, "tool", json.dumps({"tool_call_id": "a"}))] * 2 + [(1, 1, "user", "x" * 300_000)]
    found = tool_calls.link(spark.createDataFrame(rows, MESSAGES), TOOLS)
    assert found.count() == 5
    assert found.filter("kind = 'result' AND linked").count() == 2
    assert tool_calls.link(spark.createDataFrame([], MESSAGES), TOOLS).count() == 0


def test_query_has_all_kinds_of_calls(spark):
    found = tool_calls.op2_tool_calls(spark, "/root/testdata/sf0.01").collect()
    assert max(r["level"] or 0 for r in found) >= 2
    errors = " ".join(r["errors"] for r in found)
    assert all(kind in errors for kind in ("type of turn", "unknown call", "repeated id", "cyclic", "no call"))
    assert any(r["linked"] for r in found) and not all(r["linked"] for r in found)


def luhn(number):
    digits = [int(d) for d in reversed(re.sub(r"\D", "", number))]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10


TEXT = (
    "Mrs. Anna Smith met Mr. John Smith; Anna@X.com anna@x.com ANNA@X.COM call +1 (017) 555-7713 or +1 017 555 7713. "
    "4111 1111 1111 1111, 4111-1111-1111-1111, 10.0.0.1. Frau Müller Herr Müller Dr. Иван Петров 123-45-6789 "
    'DE89 3704 0044 0532 0130 00 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 47061 words, 3.5 each.'
)


@pytest.fixture(scope="module")
def replaced(spark):
    rows = [(1, TEXT), (2, None), (3, ""), (4, "anna@x.com and bob@x.com"), (4, "anna@x.com and bob@x.com"), (None, "nothing here")]
    docs = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], "doc_id long, text string, key int, by int, made int")
    out = surrogates.replace(docs, "k", count="n")
    assert out.columns == ["doc_id", "text", "key", "by", "made", "n"]
    return [tuple(r) for r in out.drop("by", "made").collect()]


def test_surrogates_keep_form_and_identity(replaced):
    texts = {}
    for i, text, _, n in replaced:
        texts.setdefault(i, []).append((text, n))
    assert len(replaced) == 6 and texts[2] == [(None, 0)] and texts[3] == [("", 0)] and texts[None] == [("nothing here", 0)]
    new, n = texts[1][0]
    assert n == 19
    for gone in ("Anna", "John", "Smith", "anna@", "7713", "4111", "10.0.0.1", "Müller", "Петров", "123-45", "3704", "24be"):
        assert gone not in new
    assert "and 47061 words, 3.5 each." in new
    mails = re.findall(r"\S+@\S+", new)
    assert mails[0].lower() == mails[1] == mails[2].lower() and mails[2].isupper() and mails[0].lower().endswith(".com")
    phones = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4})\.", new).groups()
    assert phones[:3] == phones[3:]
    cards = re.search(r"(4\d{3} \d{4} \d{4} \d{4}), (4\d{3}-\d{4}-\d{4}-\d{4})", new).groups()
    assert cards[0] == cards[1].replace("-", " ") and luhn(cards[0]) == luhn("4111 1111 1111 1111")
    family = re.search(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+);", new).groups()
    assert family[1] == family[3] and family[0] != family[2]
    assert re.search(r"Frau (\w+) Herr \1 Dr\. [А-Я][а-я]+ [А-Я][а-я]+ \d{3}-\d{2}-\d{4} DE\d{2} ", new)
    assert re.search(r'token = "[0-9a-f]{40}"', new)
    first, second = re.fullmatch(r"(\S+) and (\S+)", texts[4][0][0]).groups()
    assert first == mails[1] and first != second and len(texts[4]) == 2 and texts[4][0] == texts[4][1]


def test_surrogates_are_distinct(spark):
    rows = [(i, f"10.{i // 250}.{i % 250}.7 u{i}@b.io") for i in range(1500)]
    out = surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    pairs = [r["text"].split() for r in out]
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == 1500
    assert not {a for a, _ in pairs} & {t.split()[0] for _, t in rows}


def test_small_spaces_stay_distinct(spark):
    rows = [(i, f"{i}@b.io") for i in range(10, 60)]  # two digits: one hundred surrogates, fifty of them taken
    out = surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    assert len({r["text"].split("@")[0] + r["text"] for r in out}) == 50


def test_empty_table(spark):
    assert surrogates.replace(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_all_mentions_of_a_titled_name_are_replaced(spark):
    rows = [
        (1, "Mr John Smith met Anna. Smith left, JOHN stayed; Smithson and smith too."),
        (2, "Mrs Anna Maria Schmidt and Herr Ludwig van Beethoven. Schmidt, Maria's and Beethoven."),
        (3, "Господин Петров ушёл. Петров. Κύριος Παππάς, Παππάς!"),
        (4, "Smith alone and a@b.io"),
    ]
    out = {r["doc_id"]: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k", count="n").collect()}
    john, smith, again, loud = re.fullmatch(
        r"Mr (\w+) (\w+) met Anna\. (\w+) left, (\w+) stayed; Smithson and smith too\.", out[1]["text"]
    ).groups()
    assert smith == again != "Smith" and loud == john.upper() != "JOHN" and out[1]["n"] == 4
    words = re.fullmatch(r"Mrs (\w+) (\w+) (\w+) and Herr (\w+) van (\w+)\. (\w+), (\w+)'s and (\w+)\.", out[2]["text"]).groups()
    assert words[5:] == (words[2], words[1], words[4]) and out[2]["n"] == 8
    assert not set(words) & set("Anna Maria Schmidt Ludwig Beethoven".split())
    slavic, greek = re.fullmatch(r"Господин (\w+) ушёл\. \1\. Κύριος (\w+), \2!", out[3]["text"]).groups()
    assert slavic != "Петров" and greek != "Παππάς" and out[3]["n"] == 4
    assert out[4]["text"].startswith("Smith alone and ") and out[4]["n"] == 1


def iban_is_valid(iban):
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_one_surrogate_for_each_name_of_a_text(spark):
    rows = [
        (1, "Dr Anna Schmidt came. Mrs Anna Schmidt left. Mrs Anna smiled. Anna went."),
        (2, "Frau Kim Lee, Herr Kim Lee and Dr Kim Lee."),
    ]
    out = {r["doc_id"]: r["text"] for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    anna, schmidt = re.fullmatch(r"Dr (\w+) (\w+) came\. Mrs \1 \2 left\. Mrs \1 smiled\. \1 went\.", out[1]).groups()
    assert anna.endswith(tuple("na lia ra nia".split())) and "Anna" not in out[1] and "Schmidt" not in out[1] and anna != schmidt
    assert re.fullmatch(r"Frau (\w+) (\w+), Herr \1 \2 and Dr \1 \2\.", out[2])


def test_ibans_stay_valid(spark):
    found = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NO9386011117947"]
    assert all(map(iban_is_valid, found))
    docs = spark.createDataFrame([(k, f"pay to {i} now") for k, i in enumerate(found)], "doc_id long, text string")
    for r in surrogates.replace(docs, "k").collect():
        new = re.fullmatch(r"pay to (\w+) now", r["text"]).group(1)
        old = found[r["doc_id"]]
        assert new != old and iban_is_valid(new) and new[:2] == old[:2]
        assert [c.isdigit() for c in new[4:]] == [c.isdigit() for c in old[4:]]


def test_long_hosts_and_texts_end_no_session(spark):
    long = "a@b" + ".c" * 100_000
    rows = [(1, long), (2, "." * 300_000 + "a@b.io " + "1 " * 100_000), (3, "Mr " * 20_000 + "Smith"), (4, "aA" * 200_000)]
    out = {r["doc_id"]: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k", count="n").collect()}
    assert len(out[1]["text"]) == len(long) and out[1]["n"] == 1 and out[1]["text"] != long
    assert "a@b.io" not in out[2]["text"] and "Smith" not in out[3]["text"] and out[4]["n"] == 0


def test_the_hint_holds_for_every_entity(spark):
    """Texts of one entity each: a hint that missed a kind would leave it."""
    rows = ["a@b.io", "DE89370400440532013000", "abcdef" * 6, "ABCDEF" * 6, "10.0.0.1", "123-45-6789", "4111111111111111"]
    rows += ["+4915112345678", "0171 555 7713"] + [f"{t} Smithers" for t in re.sub(r"\[(.)(.)\]", r"\1", "|".join((surrogates.MALE, surrogates.FEMALE, surrogates.NEUTRAL))).replace("n?", "n").split("|")]
    docs = spark.createDataFrame(list(enumerate(f"x {r}." for r in rows)), "doc_id long, text string")
    left = [r["text"] for r in surrogates.replace(docs, "k", count="n").collect() if not r["n"]]
    assert not left
