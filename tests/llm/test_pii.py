import hashlib
import re

from tests.llm.helpers import ODD_TEXTS
from tagsieve.llm import pii


def rewrite(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.pseudonymise(docs, "text", key, "kinds").collect()
    return {r.doc_id: (r.text, r.kinds) for r in rows}


def plain_feistel(key, tweak, left, right, a, b):
    """The network, restated."""
    for i in range(pii.ROUNDS):
        half = right if i % 2 == 0 else left
        digest = hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()
        add = int(digest[:15], 16)
        if i % 2 == 0:
            left = (left + add % a) % a
        else:
            right = (right + add % b) % b
    return left, right


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def test_numbers_follow_the_network(spark):
    card, ip = "4111111111111111", "97.51.17.173"
    out = rewrite(spark, [f"pay {card} from {ip}."])
    left, right = plain_feistel("k", "card:0:15", 4111111, 11111111, 10**7, 10**8)
    head = f"{left:07d}{right:08d}"
    check = next(str(d) for d in range(10) if luhn(head + str(d)))
    x, y = plain_feistel("k", "ip", 97 * 256 + 51, 17 * 256 + 173, 65536, 65536)
    assert out[0] == (f"pay {head}{check} from {x >> 8}.{x & 255}.{y >> 8}.{y & 255}.", ["card", "ip"])


def test_small_domains_are_permuted(spark):
    mails = [f"{c}@example.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    out = [t for t, _ in rewrite(spark, mails).values()]
    assert sorted(out) == sorted(mails) and out != mails


def test_days_are_permuted_to_real_days_and_linked_across_formats(spark):
    out = rewrite(spark, ["on 1980-02-29", "on 29.02.1980", "on 29/02/1980", "on 30.02.1980 or 1700-01-01"])
    year, month, day = re.fullmatch(r"on (\d{4})-(\d\d)-(\d\d)", out[0][0]).groups()
    assert out[1][0] == f"on {day}.{month}.{year}" and out[2][0] == f"on {day}/{month}/{year}"
    assert out[0][1] == ["date"] and out[0][0] != "on 1980-02-29"
    assert out[3] == ("on 30.02.1980 or 1700-01-01", [])


def test_valid_values_keep_their_format_and_their_links(spark):
    texts = [
        "a und.34@mail7.example.com b",
        "UND.34@mail7.example.com",
        "+1 (017) 555-7713, again +1 (017) 555-7713",
        'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"',
        "GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432",
        "123-45-6789",
        "4111-1111-1111-1111 4111 1111 1111 1111",
    ]
    out = rewrite(spark, texts)
    for i, text in enumerate(texts):
        new, kinds = out[i]
        assert new != text and kinds
        shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
        if i != 3:
            assert shape(new) == shape(text)
    first, second = out[2][0].split(", again ")
    assert first == second and first.startswith("+1 (")
    spaced, joined = out[4][0].split(" and ")
    assert spaced.replace(" ", "") == joined
    turned = "".join(str(int(c, 36)) for c in joined[4:] + joined[:4])
    assert int(turned) % 97 == 1
    digits = out[6][0].replace("-", "").replace(" ", "")
    assert digits[:16] == digits[16:] and luhn(digits[:16])
    assert rewrite(spark, texts, "other key")[0][0] != out[0][0]


def test_what_is_not_valid_stays(spark):
    texts = [
        "4111111111111112", "300.1.1.1", "000-12-1234", "GB82WEST12345698765433", "Version 2.0. v3. 1.2.3.4.5",
        "x4111111111111111", "no values, but @ and 7", "12345",
    ]
    out = rewrite(spark, texts)
    assert [out[i][0] for i in range(len(texts))] == texts


def test_neighbours_do_not_hide_a_value(spark):
    card, iban, phone = "4111 1111 1111 1111", "BE68539007547034", "+1 555 123 4567"
    alone = {v: rewrite(spark, [v])[0][0] for v in (card, iban, "AT611904300234573201", phone)}
    assert all(new != old for old, new in alone.items())
    shapes = [
        (card, "{} 12/25"), (card, "{} 123"), (card, "12 {}"), (card, "2024 12 {} 123"), (card, "{} {}"),
        (card, "BE12 {}"), (iban, "{} USD"), (iban, "AB12 {} EUR"), ("AT611904300234573201", "{} EUR"), (phone, "{} 2024"),
    ]
    out = rewrite(spark, [form.replace("{}", v) for v, form in shapes])
    assert [out[i][0] for i in range(len(shapes))] == [form.replace("{}", alone[v]) for v, form in shapes]


def test_common_layouts_of_days_and_phones(spark):
    texts = [
        "2024-01-05", "2024-01-05T10:00:00Z", "2024-01-05/2024-01-06", "2024/01/05", "2024-01-06",
        "12/25/1990", "12/26/1990", "13/25/1990", "555.123.4567", "555 123 4567", "555-123-4567", "phone: 5551234567",
        "order 5551234567", "2024-01-05T10:00:00Z/2024-01-06T10:00:00Z",
    ]
    out = [rows[0] for rows in rewrite(spark, texts).values()]
    day, next_day = out[0], out[4]
    assert day != texts[0]
    assert out[1] == f"{day}T10:00:00Z" and out[2] == f"{day}/{next_day}" and out[3] == day.replace("-", "/")
    assert out[13] == f"{day}T10:00:00Z/{next_day}T10:00:00Z"
    for i in (5, 6):
        month, over, year = map(int, out[i].split("/"))
        assert out[i] != texts[i] and 1 <= month <= 12 < over <= 31 and 1800 <= year < 2200
    assert out[5] != out[6] and out[7] == texts[7] and out[12] == texts[12]
    digits = [re.sub("[^0-9]", "", t) for t in out[8:12]]
    assert out[8] != texts[8] and len(set(digits)) == 1
    assert re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", out[8]) and re.fullmatch(r"\d{3} \d{3} \d{4}", out[9])


def test_odd_tables(spark):
    out = rewrite(spark, ODD_TEXTS)
    assert [out[i][0] for i in range(len(ODD_TEXTS))] == ODD_TEXTS
    docs = spark.createDataFrame([(1, "a@b.org", "x")], "doc_id long, text string, kind string")
    assert pii.pseudonymise(docs, "text", "k").columns == docs.columns
    assert pii.pseudonymise(docs.limit(0), "text", "k", "kinds").count() == 0
    long = "mail a@b.org. " * 5000
    assert rewrite(spark, [long])[0][0].count("@b.org. ") == 5000


def test_long_runs_do_not_overflow(spark):
    runs = ["x@" + "a." * 100_000, "a." * 100_000 + "@b", "1 " * 100_000, "1-" * 50_000 + "a@", "@" * 50_000, "+1" * 50_000,
            "AB12 " * 40_000, "1.1.1." * 30_000, "token=" * 30_000 + "1"]
    out = rewrite(spark, runs)
    assert len(out) == len(runs)
    assert all(len(out[i][0]) == len(t) for i, t in enumerate(runs) if i not in (7,))
