from datetime import date, timedelta

from hypothesis import given
from hypothesis import strategies as st

from postern.functions import headers as H


def test_encoded_words():
    assert H.decode_words("=?utf-8?b?4piF?= x") == ("★ x", True, False, False)
    assert H.decode_words("=?utf-8?b?4pg=?= =?UTF8?b?hQ==?=")[0] == "★"
    assert H.decode_words("=?utf-8?q?a_b?=\r\n =?latin-1?q?=E9?=")[0] == "a bé"
    assert H.decode_words("=?nope?q?a?=") == ("=?nope?q?a?=", False, True, False)
    assert H.decode_words("=?utf-8?q?=E9?=") == ("é", True, False, True)


def test_parameters():
    assert H.parameters("a; filename*1=b; filename*0=a") == [("filename", "ab", "decoded", None)]
    assert H.parameters("a; n*=utf-8''%e2%98%85; n=x") == [("n", "★", "decoded", None)]
    assert H.parameters("a; n*=''x")[0][2:] == ("fallback", "empty_charset")
    assert H.parameters("a; n*0=x; n*2=y")[0][3] == "missing_continuation_index"
    assert H.parameters('a; n="x;\\"y"') == [("n", 'x;"y', "decoded", None)]


def test_addresses():
    rows = H.addresses(b" Friends: ben@x.test, Cara <c@x.test>; d@x.test")
    assert [(r["state"], r["addr_spec"], r["member"]) for r in rows] == [("group", None, False), ("parsed", "ben@x.test", True), ("parsed", "c@x.test", True), ("parsed", "d@x.test", False)]
    assert H.addresses(b' "Doe, Jane" <j@x.test>')[0]["display_name"] == "Doe, Jane"
    assert H.addresses(b"<@r.test,@s.test:u@x.test>")[0]["addr_spec"] == "u@x.test"
    assert H.addresses(b"(a (b) c) u@[1.2.3.4]")[0]["addr_spec"] == "u@[1.2.3.4]"
    assert H.addresses(b"nobody")[0]["reason_id"] == H.UNPARSABLE


def test_dates():
    assert H.parse_date(" Tue, 4 Mar 2025 08:05:00 +0100") == ("zone_stated", "+0100", "2025-03-04T07:05:00+00:00", None)
    assert H.parse_date("4 Mar 25 08:05 EST (x (y))")[2] == "2025-03-04T13:05:00+00:00"
    assert H.parse_date("4 Mar 2025 08:05:60 Z") == ("zone_stated_minus_zero", "-0000", "2025-03-04T08:05:60+00:00", None)
    assert H.parse_date("4 Mar 2025 08:05")[3] == H.NO_ZONE
    assert H.parse_date("30 Feb 2025 08:05 +0000")[3] == H.INVALID


@given(st.dates(date(1, 1, 2), date(9999, 12, 30)))
def test_calendar_agrees_with_the_library(d):
    n = H.days_from_civil(d.year, d.month, d.day)
    assert date(1970, 1, 1) + timedelta(n) == d
    assert H.civil_from_days(n) == (d.year, d.month, d.day)


@given(st.text(max_size=80))
def test_grammars_never_raise(text):
    raw = text.encode("utf-8", "replace")
    value = raw.decode("latin-1")
    H.decode_words(value), H.parameters(value), H.parse_date(value), H.addresses(raw)
