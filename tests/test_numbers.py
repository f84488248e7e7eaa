import random

from pyspark.sql import functions as F

from tabprep.operators.privacy import checked_numbers, luhn, mod_97


def by_hand(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return len(digits) > 1 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def remainder(number):
    bare = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def test_check_digits(spark):
    rng = random.Random(1)
    cards = ["".join(rng.choices("0123456789", k=16)) for _ in range(300)] + ["4539 1488 0343 6467", "4539-1488-0343-6467", "0", "", "79927398713"]
    df = spark.createDataFrame([(c,) for c in cards], "c string")
    assert [r[0] for r in df.select(luhn(F.col("c"))).collect()] == [by_hand(c) for c in cards]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765433", "FR1420041010050500013M02606"]
    ibans += ["DE" + "".join(rng.choices("0123456789ABZ", k=20)) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in ibans], "c string")
    assert [r[0] for r in df.select(mod_97(F.col("c"))).collect()] == [remainder(c) for c in ibans]


def test_random_digits_hardly_count(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices("0123456789", k=1)) + "x" if i % 50 == 0 else "".join(rng.choices("0123456789", k=16)),) for i in range(1000)]
    found = checked_numbers(spark.createDataFrame(rows, "t string")).where("kind = 'card'").first()
    assert found["found"] == 980 and found["valid"] == found["values"] == sum(by_hand(t) and len(t) == 16 for (t,) in rows) < 140


def test_texts(spark):
    rows = [("pay 4539-1488-0343-6467 or 4539148803436467.",), (None,), ("",), ("DE89370400440532013000, x45391488034364670",)]
    found = [tuple(r) for r in checked_numbers(spark.createDataFrame(rows, "`a b.c` string")).collect()]
    assert found == [("a b.c", "card", 2, 2, 1), ("a b.c", "iban", 1, 1, 1)]
    assert [tuple(r)[2:] for r in checked_numbers(spark.createDataFrame([], "t string")).collect()] == [(0, 0, 0)] * 2
