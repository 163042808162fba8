import pytest

from meshwright.llm.pii import find_pii, iban_remainder, luhn_digit, permute_text, pii_items, pii_replaced, pseudonym, replace_pii, valid_nino, valid_ssn

KEY = b"k" * 32


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Contact person Olka Calbald (ngrist@tilreck.invalid)", [("person_name", "Olka Calbald"), ("email", "ngrist@tilreck.invalid")]),
        ("Mail cewen.ist (at) kelix (dot) test now", [("email", "cewen.ist (at) kelix (dot) test")]),
        ("Mail fifred.har[at]tilvane.example. Then", [("email", "fifred.har[at]tilvane.example")]),
        ("go to mipita dot ombdric at zorard dot example or", [("email", "mipita dot ombdric at zorard dot example")]),
        ("a copy to be.no @ wen. example.org. Selon", [("email", "be.no @ wen. example.org")]),
        ("gain@48GHz stayed flat; let u@v denote; x@t0 = y@t1 (.", []),
        ("tel. +44 (0) 20-7946 0530 or 2O2-555-O188, (202)\n555-0128", [("phone", "+44 (0) 20-7946 0530"), ("phone", "2O2-555-O188"), ("phone", "(202)\n555-0128")]),
        ("Batch +67 746 456 was rejected. Serial 033 3706 8369 is printed.", []),
        ("Compound 4839-13-2, file 788-39-6322A, No. 10/490,769, list: 240-560, 561.593.25", []),
        ("holder of passport no. 666-79-6335; tax reference QQ 35 81 76 C, ID KD-755-189-7, 77371219-Q", [("id_number", "666-79-6335"), ("id_number", "QQ 35 81 76 C"), ("id_number", "KD-755-189-7"), ("id_number", "77371219-Q")]),
        ("lives at 12 Pemmoor Mill Road, Ostwick; Calle Marsund 6, X; Linettagasse 166, Y", [("street_address", "12 Pemmoor Mill Road"), ("street_address", "Calle Marsund 6"), ("street_address", "Linettagasse 166")]),
        ("post (159 CALSTAD LANE\nPORT) and 143, avenue Ombquist and Sathsundstr. 10b", [("street_address", "159 CALSTAD LANE"), ("street_address", "143, avenue Ombquist"), ("street_address", "Sathsundstr. 10b")]),
        ("The pole stands on Wenetta Road, opposite the mast.", []),
        ("Thanks are due to Kapita van der Harhof for the loan.", [("person_name", "Kapita van der Harhof")]),
        ("Mibert Dovimo and Gonos Marrel-Calimo filed an objection in time.", [("person_name", "Mibert Dovimo"), ("person_name", "Gonos Marrel-Calimo")]),
        ("Please call Ms YORLOW, Mipita on Monday. D'après G. D. Tilquist, le", [("person_name", "YORLOW, Mipita"), ("person_name", "G. D. Tilquist")]),
        ("joindre M. G. G. Kelquist au bureau. Signed by noretta, ralya before the clerk", [("person_name", "G. G. Kelquist"), ("person_name", "noretta, ralya")]),
        ("Wenmoor Systems and Tilwick & Feldric sell. The Linhof Norova Foundation paid. The Felten filter. Call the routine Quarrel Reset 451 times.", []),
        ("registry of Norvane Zorstad Ltd. METHOD FOR MOUNTING A CHARGE PUMP", []),
        ("", []), (None, []),
    ],
)
def test_finds(text, want):
    assert [(k, text[a:b]) for a, b, k in find_pii(text)] == want


def test_pseudonyms_keep_format_and_link():
    a = pseudonym("phone", "+44 20 7946 0300", KEY)
    assert a != "+44 20 7946 0300" and [c.isdigit() for c in a] == [c.isdigit() for c in "+44 20 7946 0300"]
    assert a == pseudonym("phone", "+44 20\n7946 0300", KEY) != pseudonym("phone", "+44 20 7946 0300", b"other")
    assert pseudonym("person_name", "YORLOW, Mipita", KEY) == pseudonym("person_name", "Mipita Yorlow", KEY)
    assert pseudonym("email", "A.b (at) c (dot) test", KEY) == pseudonym("email", "a.b@c.test", KEY)
    for text in ("990805-4514", "QQ 35 81 76 C", "Ø. Zorvaneström", "a", "7", ""):
        assert permute_text(permute_text(text, KEY), KEY, back=True) == text
    assert len({permute_text(f"{i:03d}", KEY) for i in range(1000)}) == 1000


@pytest.mark.parametrize(
    ("kind", "value"),
    [
        ("id_number", "123-45-6789"), ("id_number", "666-79-6335"), ("id_number", "12345678-Z"), ("id_number", "77371219-Q"), ("id_number", "811228-9874"), ("id_number", "811228-9871"), ("id_number", "999999-1234"), ("id_number", "AB 35 81 76 C"), ("id_number", "QQ 35 81 76 C"),
        ("birth_date", "12.03.1961"), ("birth_date", "1961-03-12"), ("birth_date", "31/02/1961"), ("phone", "+49 30 901820"), ("phone", "(202) 555-0128 ext. 42"), ("account_number", "GB82 WEST 1234 5698 7654 32"), ("account_number", "4539 1488 0343 6467"),
    ],
)
def test_pseudonyms_stay_as_valid(kind, value):
    new = pseudonym(kind, value, KEY)
    assert new != value and pseudonym(kind, new, KEY, back=True) == value
    assert [c.isdigit() for c in new] == [c.isdigit() for c in value] or kind == "account_number"
    digits, of = "".join(c for c in new if c.isdigit()), "".join(c for c in value if c.isdigit())
    if value.count("-") == 2 and kind == "id_number":
        assert valid_ssn(digits) == valid_ssn(of)
    if value[:2] in ("AB", "QQ"):
        assert valid_nino(new[:2]) == valid_nino(value[:2])
    if value[-2:] in ("-Z", "-Q"):
        right = lambda v: "TRWAGMYFPDXBNJZSQVHLCKE"[int(v[:8]) % 23] == v[-1]
        assert right(new) == right(value) == (value == "12345678-Z")
    if len(of) == 10 and kind == "id_number":
        right = lambda d: luhn_digit([int(c) for c in d[:9]]) == int(d[9])
        assert right(digits) == right(of) == (value == "811228-9874")
    if value[:2] == "GB":
        assert iban_remainder(new) == 1 == iban_remainder(value)
    if value[:4] == "4539":
        assert new[:7] == value[:7] and luhn_digit([int(c) for c in digits[:-1]]) == int(digits[-1])


def test_forms_of_one_phone_number_stay_linked():
    a, b, c = (pseudonym("phone", x, KEY) for x in ("+49 151 2345678", "0049 151 2345678", "0151 2345678"))
    assert a.startswith("+49 151 ") and b.startswith("0049 151 ") and a[-7:] == b[-7:] == c[-7:] != "2345678"


def test_accounts_and_dates():
    text = "Pay GB82 WEST 1234 5698 7654 32 or card 4539 1488 0343 6467, not 4539 1488 0343 6468. Born on 12.03.1961; filed 12.03.1999."
    assert [(k, text[a:b]) for a, b, k in find_pii(text) if k in ("account_number", "birth_date")] == [("account_number", "GB82 WEST 1234 5698 7654 32"), ("account_number", "4539 1488 0343 6467"), ("birth_date", "12.03.1961")]
    long = "x" * 300 + "@c.test and " + "y" * 90 + " dot z at w dot test."
    assert [long[a:b] for a, b, _ in find_pii(long)] == ["x" * 300 + "@c.test", "y" * 90 + " dot z at w dot test"]


def test_rest_stays():
    text = "x " * 60_000 + "Mail a.b@c.test, see claim 2."
    out = replace_pii(text, KEY)
    assert out.startswith(text[:-27]) and out.endswith(", see claim 2.") and "[EMAIL:" in out and "a.b@c.test" not in out


def test_table(spark):
    docs = spark.createDataFrame([(1, "Mail a.b@c.test", "clash"), (1, "Mail a.b@c.test", ""), (2, None, ""), (3, "", "")], "doc_id bigint, text string, pii_kind string")
    assert sorted((r.doc_id, r.pii_kind, r.char_start) for r in pii_items(docs, "s").collect()) == [(1, "email", 6)] * 2
    assert {r.doc_id: r.text for r in pii_replaced(docs, "s").collect()}[2] is None
    assert pii_items(docs.limit(0), "s").count() == 0
