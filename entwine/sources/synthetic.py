"""A small synthetic registry with noisy copies, for tests and demonstrations."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Companies, addresses and countries to start from.
COMPANIES = (
    ("Bluewater Logistics LLC", "1200 Harbor St, Oakland, CA 94607", "US"),
    ("Northwind Outfitters Inc", "45 Lake Ave, Madison, WI 53703", "US"),
    ("Granite Peak Software Corp", "900 Summit Blvd, Denver, CO 80202", "US"),
    ("Desert Rose Bakery", "77 Mesa Dr, Tucson, AZ 85701", "US"),
    ("Shree Ganesh Textiles Pvt Ltd", "Plot No. 12, MG Road, Surat, 395003", "India"),
    ("Himalaya Tea Company", "8 Mall Road, Darjeeling, 734101", "India"),
    ("Deccan Steel Works Limited", "14 Station Road, Pune, 411001", "India"),
    ("Boulangerie du Marché SARL", "3 rue de la Paix, Lyon, 69001", "France"),
    ("Ateliers Dupont SAS", "21 avenue Foch, Lille, 59000", "France"),
)
# Spellings that a noisy source uses for another.
NAME_SWAPS = (("Pvt Ltd", "Private Limited"), ("Corp", "Corporation"), ("Inc", "Incorporated"), (" and ", " & "), ("Company", "Co"))
ADDRESS_SWAPS = (("St,", "Street,"), ("Ave,", "Avenue,"), ("Dr,", "Drive,"), ("Road", "Rd"), ("Blvd", "Boulevard"))


def corrupt_name(name: str, rng: random.Random) -> str:
    """Swap a spelling, add an alias in brackets, or double a letter, each by chance."""
    for a, b in NAME_SWAPS:
        if a in name and rng.random() < 0.5:
            name = name.replace(a, b)
    if rng.random() < 0.25:
        name += f" ({name.split()[0]} Express)"
    if rng.random() < 0.25:
        at = rng.randrange(1, max(2, len(name) - 1))
        name = name[:at] + name[at - 1] + name[at:]
    return name


def corrupt_address(address: str, rng: random.Random) -> str:
    """Swap street words, put a landmark before it, or drop the last segment, each by chance."""
    for a, b in ADDRESS_SWAPS:
        if rng.random() < 0.5:
            address = address.replace(a, b)
    if rng.random() < 0.3:
        address = "Near City Hospital, " + address
    if rng.random() < 0.2 and "," in address:
        address = address.rpartition(",")[0]
    return address


def registry(spark: SparkSession, n: int = 100, singletons: float = 0.35, distractors: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(S1 records, pool records, gold): entities with numbered names, noisy copies of most in S2 and S3."""
    rng = random.Random(seed)
    first, rest, gold, numbers = [], [], [], {"S2": 0, "S3": 0}

    def copy(name: str, address: str, country: str) -> str:
        source = "S2" if rng.random() < 0.65 else "S3"
        numbers[source] += 1
        rest.append((f"{source}-{numbers[source]:05d}", corrupt_name(name, rng), corrupt_address(address, rng), country, source, len(rest)))
        return rest[-1][0]

    for i in range(n):
        name, address, country = COMPANIES[i % len(COMPANIES)]
        name = f"{name.split()[0]} {chr(65 + i // len(COMPANIES) % 26)}{i} {' '.join(name.split()[1:])}"
        address = f"{100 + i} " + address.lstrip("0123456789 ")
        first.append((f"S1-{i + 1:05d}", name, address, country, "S1", i))
        if rng.random() >= singletons:
            gold += [(first[-1][0], copy(name, address, country)) for _ in range(rng.choice((1, 1, 2, 3)))]
    for i in range(distractors):
        copy(f"Unrelated {i} Trading", f"{i} Nowhere Lane, {10000 + i}", rng.choice(("US", "India", "France")))
    kind = "entity_id string, business_name string, business_address string, country string, source string, row_ord long"
    return spark.createDataFrame(first, kind), spark.createDataFrame(rest, kind), spark.createDataFrame(gold, "s1 string, r string")
