"""Python workers live on for later tasks: a task must leave its worker about as small as it found it."""

import subprocess
import sys

import pytest

SCRIPT = """
import random, sys
import public_tokenizers, pyarrow as pa
from tidemark.llm import near_duplicates, segmentations

def used():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) / 1024

def batches(n):
    rng = random.Random(n)
    for _ in range(12):
        texts = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 14))) for _ in range(500)) for _ in range(60)]
        ids = pa.array(range(60), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["row_id", "text"]) if sys.argv[1] != "near" else pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["row_id", "body", "text"])

runs = {
    "near": near_duplicates._signer(5),
    "pieces": segmentations._sampler(public_tokenizers.path("piece_bpe_32k.model"), 1.0, 2, 7),
}
run = runs[sys.argv[1]]
for _ in run(batches(0)):  # libraries are loaded
    pass
before, most = used(), 0
for _ in run(batches(1)):
    most = max(most, used())
print(before, most, used())
"""


@pytest.mark.parametrize("which", ["near", "pieces"])
def test_a_task_gives_its_memory_back(which):
    said = subprocess.run([sys.executable, "-c", SCRIPT, which], capture_output=True, text=True, check=True).stdout.split()
    before, most, after = map(float, said)
    assert after - before < 15 and before < 420, (before, most, after)
