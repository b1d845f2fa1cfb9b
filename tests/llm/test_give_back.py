"""What a worker holds free between tasks goes back to the machine."""

import pyarrow as pa

from tidemark.llm.common import by_batch


def rss():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 // 1_000_000


class Frame:
    def mapInArrow(self, run, schema):
        return run


def test_free_memory_is_given_back_after_the_last_batch():
    held, seen = [], []

    def fn(batch):
        kept = [b"x" * 20_000 for _ in range(10_000)]  # 200 MB in parts too small to be mapped one by one
        held.append(kept[::100])  # lie between the others, so that these cannot be cut off at the end
        del kept
        seen.append(rss())
        return batch

    batch = pa.record_batch([pa.array([1])], names=["a"])
    assert list(by_batch(Frame(), fn, "a long")(iter([batch]))) == [batch]
    assert rss() < seen[0] - 100
