"""What tasks leave behind."""

import os

import pytest

from quire.llm.common import released


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="needs /proc")
def test_a_task_gives_its_memory_back():
    kept = []

    def run(batches):
        held = [bytes(2000) for _ in range(100_000)]  # 200 MB below something that stays
        kept.append(bytes(2000))
        yield len(held)

    before = resident()
    assert list(released(run)(iter([]))) == [100_000]
    assert resident() - before < 60 << 20
