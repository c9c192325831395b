import os

from oreflow.llm import common


def test_memory_freed_in_a_task_goes_back():
    """Blocks freed below one that stays are given back, so that idle workers don't hold what their largest task needed."""
    own = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")  # noqa: E731, SIM115
    common.release()
    before = own()
    held = [bytes(5_000) for _ in range(40_000)]
    last = held.pop()
    assert own() - before > 150_000_000
    del held
    common.release()
    assert own() - before < 60_000_000 and last
