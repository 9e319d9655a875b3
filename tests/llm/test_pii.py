import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from placeloom.llm import pii
from placeloom.llm.pii import BASE_KINDS, KINDS, automaton, find, luhn, mask, pii_spans

ANCHORS = automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in re.findall("[0-9]+", m[0])), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a@.+ -1023456789()%é", max_size=80))
def test_base_kinds_equal_patterns(text):
    assert [s for s in find(text, ANCHORS) if s[2] in BASE_KINDS] == brute(text)


def test_added_kinds():
    text = "at https://bob:pw@host.example.com/x, account no: 12345678 and IBAN GB82 WEST 1234 5698 7654 32 end"
    got = [(k, text[a:b]) for a, b, k in find(text, ANCHORS) if k not in BASE_KINDS]
    assert got == [("address", "https://bob:pw@host.example.com"), ("account", "12345678"), ("account", "GB82 WEST 1234 5698 7654 32")]
    assert "bob" not in mask(text, find(text, ANCHORS))
    assert find("the account was closed; IBAN GB82 WEST 1234 5698 7654 33", ANCHORS) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "x " * 200_000 + "a@b.cc", 7), (3, "x a@b.cc", None), (None, "a@b.cc", 1)], "doc_id long, text string, pii_spans int")
    rows = pii_spans(df).orderBy("doc_id").collect()
    assert [r.pii_spans for r in rows if r.doc_id in (1, 2)] == [[], []]
    assert sorted(r.pii_spans[0] for r in rows if r.pii_spans) == ["email:0:6", "email:2:8", "email:400000:400006"]
    assert pii_spans(df.limit(0)).count() == 0
    assert [r.text for r in pii.mask_pii(df.filter("doc_id is null")).collect()] == ["<EMAIL>"]


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "mail a.b@c.de, 10.0.0.1", "en", "s", 1), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    one, two = pii.op8_anchor_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0)
    assert one.base_sha256 == hashlib.sha256(b"email:5:13,ip:15:23").hexdigest()
    assert two.spans == "" and two.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_cues_in_any_case(spark):
    cues = ["Customer ID", "Customer Id", "Member ID", "User ID", "user iD", "Iban", "IBan", "AcCt", "SSn", "account", "Account", "PASSPORT"]
    texts = [f"{lead}{cue}: AB123456 end" for cue in cues for lead in ("", "İ ß É: ")]
    for t in texts:
        assert [(k, t[a:b]) for a, b, k in find(t, ANCHORS)] == [("account", "AB123456")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert all("AB123456" not in r.text and "<ACCOUNT> end" in r.text for r in pii.mask_pii(df).collect())
