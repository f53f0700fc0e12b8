import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii


def plain(text):
    """The base kinds by their plain patterns."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.text("a.@-%01259 +()é\n", max_size=60))
def test_base_against_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "1.2.3.256", "a@b.co", "a@b@c.de", "+33 6 12 34 56 78", " ", "x", "1", ".", "é"]), max_size=12).map("".join))
def test_base_on_joined_pieces(text):
    assert pii.base_spans(text) == plain(text)


def test_added_kinds():
    text = "Pay to account GB82 WEST 1234 5698 7654 32 or GB83 WEST 1234 5698 7654 32. My SSN 123-45-6789, code 123-45-6788"
    found = {s for s, _ in pii.find_pii(text) if s[0] in pii.ADDED}
    assert ("iban", 15, 42) in found and sum(k == "iban" for k, *_ in found) == 1
    assert any(k == "ssn" for k, *_ in found)
    assert not any(k == "ssn" for (k, *_), _ in pii.find_pii("code 123-45-6788"))


def test_long_texts_are_linear():
    for text in ("9" * 300_000, "a" * 300_000 + " x@y", "+" * 200_000, "1." * 100_000, "@" * 200_000):
        pii.find_pii(text)


def test_query_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail bob@example.com now"), (3, "mail bob@example.com now"), (None, "1.2.3.4")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    got = pii.pii_spans(docs).collect()
    assert len(got) == 5
    empty = hashlib.sha256(b"").hexdigest()
    by = [(r.doc_id, r.n_email, r.n_ip, r.spans) for r in got]
    assert (1, 0, 0, "") in by and (2, 0, 0, "") in by and by.count((3, 1, 0, "email:5:20")) == 2 and (None, 0, 1, "ip:0:7") in by
    assert next(r.base_sha256 for r in got if r.doc_id == 1) == empty
    assert pii.pii_spans(docs.limit(0)).count() == 0


def test_iban_before_other_words():
    for text, want in [
        ("IBAN DE89370400440532013000 BIC COBADEFFXXX", ["DE89370400440532013000"]),
        ("DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 EUR 500", ["DE89370400440532013000"]),
        ("GB82WEST12345698765432 2024 invoice", ["GB82WEST12345698765432"]),
        ("DE89370400440532013000 GB82WEST12345698765432", ["DE89370400440532013000", "GB82WEST12345698765432"]),
        ("AB12 DE89370400440532013000 x", ["DE89370400440532013000"]),
        ("NO9386011117947, MT84MALT011000012345MTLCAST001S", ["NO9386011117947", "MT84MALT011000012345MTLCAST001S"]),
        ("DE893704004405320130001", []), ("DE89370400440532013000x", []), ("DE88370400440532013000 BIC", []),
    ]:
        assert [text[a:b] for k, a, b in pii.added_spans(text) if k == "iban"] == want, text
    assert not pii.ibans("AA00 " * 60_000)
