"""Surrogates of values that can't change within their format, or whose format is in full use."""

from quillsift.llm import surrogates


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.text, r.n_entities) for r in surrogates.pseudonymize(docs, key).collect()}


def test_values_without_letters_or_digits(spark):
    got = replaced(spark, ["password: ______", "token = ------", "write to _@example.com", "password: __a1b2__"])
    assert got[0] == ("password: ______", 0) and got[1] == ("token = ------", 0)
    assert got[2][1] == 1 and got[2][0] != "write to _@example.com" and got[2][0].endswith("@example.com")
    assert got[3][1] == 1 and got[3][0] != "password: __a1b2__"


def test_format_in_full_use(spark):
    mails = [f"{a}{d}@example.com" for a in "abcdefghijklmnopqrstuvwxyz" for d in "0123456789"]
    key = next(k for k in map(str, range(1000)) if sum(surrogates.surrogate(k.encode(), "email", m) == m for m in mails) == 1)
    got = [t for t, _ in replaced(spark, mails, key).values()]
    assert len(set(got)) == len(mails)
    assert all(new != old for new, old in zip((t for _, (t, _) in sorted(replaced(spark, mails, key).items())), mails, strict=True))


def test_wider_formats_differ():
    values = {"email": "_@example.com", "ip": "10.1.2.3", "card": "4111111111111111", "phone": "212-555-0100", "ssn": "123-45-6789", "access": "AKIA" + "A" * 16, "secret": "abc123"}
    for kind, value in values.items():
        tried = [surrogates.surrogate(b"k", kind, value, n) for n in range(1, 30)]
        assert value not in tried and len({len(x) for x in tried}) > 20
        if kind == "card":
            assert all(surrogates.luhn(x) for x in tried)


def test_one_person_has_one_name():
    """Titles of several genders, given names alone, capitals, labels without a title."""
    text, n = surrogates.rewrite("Mrs Anna Smith met Dr Anna Smith. Anna left. ANNA SMITH smith Smith's annals.", b"k", {})
    words = text.replace(".", "").split()
    given, last = words[1], words[2]
    assert (given, last) == (words[5], words[6]) and words[7] == given and words[9] == given.upper() and words[10] == last.upper()
    assert words[11] == "smith" and words[12] == f"{last}'s" and words[13] == "annals" and n == 8
    assert not {"Anna", "Smith"} & set(words) and given.endswith("a")
    labelled, n = surrogates.rewrite("Contact: John Doe\nJohn called. Contact: us", b"k", {})
    assert n == 3 and "John" not in labelled and "Doe" not in labelled and labelled.endswith("Contact: us")
    assert labelled.split()[1] == labelled.split()[3]


def test_spellings_share_a_surrogate():
    text = "Jo.Lee@Mail.org jo.lee@mail.org (212) 555-0187 212.555.0187 +1 212-555-0187 4111 1111 1111 1111 4111111111111111"
    new, n = surrogates.rewrite(text, b"k", {})
    a, b, rest = *new.split(" ")[:2], new.split(" ", 2)[2]
    assert n == 7 and a.lower() == b and a != b and a[0].isupper() and b != "jo.lee@mail.org"
    digits = lambda s: "".join(c for c in s if c.isdigit())
    phones = [rest[:14], rest[15:27], rest[28:43]]
    assert rest[0] == "(" and phones[2].startswith("+1 ") and len({digits(p)[-10:] for p in phones}) == 1 and digits(phones[0]) != "2125550187"
    assert digits(rest[44:63]) == rest[64:80] and rest[48] == " " and surrogates.luhn(rest[64:80])


def test_names_of_all_kinds_differ(spark):
    """Given names of both genders and surnames keep apart over the corpus."""
    import re

    names = [f"{a}{b}" for a in ("Al", "Be", "Ca", "Do", "Ed", "Fi") for b in ("na", "ro", "li", "ta", "men", "vis", "ka")]
    texts = [f"Mr {x} {y} and Mrs {y} {x}" for x, y in zip(names, names[1:] + names[:1], strict=True)]
    made = {}
    for i, (t, _) in replaced(spark, texts).items():
        for old, new in zip(re.findall(r"\w+", texts[i]), re.findall(r"\w+", t), strict=True):
            made.setdefault(new, set()).add(old)
    assert all(len(v) == 1 for v in made.values()) and not set(made) & set(names)
