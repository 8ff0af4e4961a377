"""Personal data of forms that the test documents do not have."""

import re
from ipaddress import IPv6Address

from tabloom.llm import surrogates

KEY = b"k"


def rewritten(text, known=None):
    return surrogates._rewritten(text, known or {}, KEY)[0]


def test_secrets_are_replaced_to_their_end():
    for n in (600, 2_000, 60_000):
        secret = ("Ab3-_x.9" * n)[:n]
        new = rewritten(f'token = "{secret}" rest')
        assert new.startswith('token = "') and new.endswith('" rest') and len(new) == len(secret) + 15
        assert sum(a == b for a, b in zip(new[9:-6], secret)) < n * 0.5 and secret[-40:] not in new
    for secret in ("ghp_" + "a1B2" * 100, "sk-" + "Zx90" * 100, "sk-proj-" + "aB3_-x" * 10):
        assert secret[-20:] not in rewritten(f"key {secret} end") and rewritten(f"key {secret} end").endswith(" end")
    one, two = (surrogates.surrogate(KEY, "secret", "q" * 3_000 + c) for c in "ab")
    assert one != two


def test_whole_names_and_their_further_mentions(spark):
    texts = [
        "Mr. John Ronald Tolkien wrote. Later Tolkien left; Tolkien's book and John stayed.", "Dr. Anna-Maria Klein came.",
        "Frau von Weber sang.", "Herr Dr. Jürgen van der Berg and Mrs. O'Brien met.", "Mr. J. R. R. Hobbes slept.", "Mr. John came.",
        "Mr. John Smith came.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in surrogates.replace_report(docs, key=KEY).orderBy("doc_id").collect()]
    for word in ("John", "Ronald", "Tolkien", "Anna", "Maria", "Klein", "Weber", "Jürgen", "Berg", "Brien", "Hobbes", "J. R. R.", "Smith"):
        assert not any(word in t for t in got), word
    first = got[0].split()
    assert first[3] == first[6] and first[8] == first[3] + "'s" and first[1] == first[11]
    assert got[2].startswith("Frau von ") and " van der " in got[3] and got[3].startswith("Herr Dr. ")
    # One surrogate for a word, as a surname and as a given name.
    assert got[5].split()[1] == got[6].split()[1] == first[1]


def test_numbers_of_other_countries():
    for phone in ("+44 20 7946 0958", "+49 30 1234567", "+33 1 23 45 67 89", "5551234567", "+4915112345678", "+352 26 12 34 56", "+1 (013) 555-9871"):
        new = rewritten(f"call {phone}, please")[5:-8]
        assert new != phone and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", phone), phone
        assert phone[0] != "+" or new.split(" ")[0][:2] == phone.split(" ")[0][:2]
    assert rewritten("+44 20 7946 0958") == rewritten("+442079460958").replace("+44", "+44 ", 1)[:6] + " " + rewritten("+442079460958")[5:9] + " " + rewritten("+442079460958")[9:]


def test_short_forms_of_ip6():
    for address in ("2001:db8::1", "fe80::1ff:fe23:4567:890a", "2001:DB8:0:0:8:800:200C:417A", "::ffff:93.184.216.34", "1:2:3:4:5:6:7:8", "2001:db8::", "::ffff:5db8:d822"):
        new = rewritten(f"from {address} on")[5:-3]
        assert IPv6Address(new) != IPv6Address(address) and new.count(":") == address.count(":"), address
    same = {IPv6Address(rewritten(a)) for a in ("2001:db8::1", "2001:0db8:0:0:0:0:0:1", "2001:DB8:0::0:1")}
    assert len(same) == 1
    assert IPv6Address(rewritten("::ffff:93.184.216.34")) == IPv6Address(rewritten("::ffff:5db8:d822"))
    for text in ("at 12:30 and 10:15:20", "std::vector a::b", "::1", "key: value"):
        assert rewritten(text) == text
