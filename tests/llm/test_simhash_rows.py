"""How many rows op4's exchange makes by chance, whatever the number of fingerprints."""

from graphloom.llm import packed
from graphloom.llm.simhash import SPARE


def test_chance_meetings_are_one_share_of_any_number_of_variants():
    for n in (200, 2000, 45_000, 225_000, 2_000_000, 13_000_000, 100_000_000):
        at = packed.layout(n * 2081, max(1, n // 1024), spare=SPARE)
        assert 2.0 ** -(SPARE + 1) <= n * 2081 / 2**at.bits <= 2.0**-SPARE
