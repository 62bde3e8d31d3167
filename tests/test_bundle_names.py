"""Bundle names against a direct simulation, adversarial names included."""

import random
import time

import pytest

from foliomill.operators import lifecycle, skew
from foliomill.operators.lifecycle import bundle_names


def simulate(files):
    """Smallest free number, file after file."""
    taken, out = {}, {}
    for job, file_id, stem, ext in sorted(files, key=lambda f: f[1]):
        used = taken.setdefault(job, set())
        name, n = stem + ext, 1
        while name in used:
            n += 1
            name = f"{stem}-{n}{ext}"
        used.add(name)
        out[(job, file_id)] = name
    return out


def run(spark, files):
    df = spark.createDataFrame(
        [(job, fid, f"{stem}.html", f"output/{job}/{fid}{ext}") for job, fid, stem, ext in files],
        "job_id long, file_id string, original_filename string, output_path string",
    )
    return {(r.job_id, r.file_id): r.member_name for r in bundle_names(df).collect()}


@pytest.mark.parametrize("stretch, hot", [(10_000, 20_000), (2, 3)])
def test_literal_numbers_and_duplicates(spark, monkeypatch, stretch, hot):
    monkeypatch.setattr(lifecycle, "STRETCH", stretch)
    monkeypatch.setattr(lifecycle, "HOT", hot)
    monkeypatch.setattr(skew, "HOT", hot)
    rng = random.Random(7)
    stems = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-3-2", "a-10", "a-02", "b", "b-1", "a-4", "a-2-2-2"]
    files = []
    for job in range(60):
        for _ in range(rng.randint(1, 40)):
            pool = stems if job % 2 else stems[:5]
            files.append((job, f"{rng.getrandbits(128):032x}", rng.choice(pool), rng.choice([".md", ".md", ".pdf"])))
    assert run(spark, files) == simulate(files)


def test_plain_duplicates_need_no_sibling_work(spark):
    files = [(1, f"{i:032x}", "same", ".md") for i in range(300)]
    named = run(spark, files)
    assert named == simulate(files)
    assert len(set(named.values())) == 300


def test_very_many_siblings_beside_one_name(spark):
    """Linear in the siblings; numbers are settled a stretch after the other."""
    rng = random.Random(5)
    count = 25_000
    files = [(1, f"{rng.getrandbits(128):032x}", stem, ".md") for n in range(2, count + 2) for stem in ("page", f"page-{n}")]
    started = time.monotonic()
    named = run(spark, files)
    took = time.monotonic() - started
    taken, pointer, out = set(), 1, {}
    for _, file_id, stem, _ in sorted(files, key=lambda f: f[1]):
        name = stem
        if stem == "page":
            while (name := "page" if pointer == 1 else f"page-{pointer}") in taken:
                pointer += 1
        else:
            n = 1
            while name in taken:
                n += 1
                name = f"{stem}-{n}"
        taken.add(name)
        out[1, file_id] = name + ".md"
    assert named == out and took < 120


def test_suspicious_or_missing_outputs_are_left_out(spark):
    df = spark.createDataFrame(
        [(1, "00", "x.html", "../x.md"), (1, "01", "x.html", None), (1, "02", "x.html", "output/1/x.md")],
        "job_id long, file_id string, original_filename string, output_path string",
    )
    assert [r.member_name for r in bundle_names(df).collect()] == ["x.md"]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_names_take_one_pass_unless_a_job_is_large(spark, monkeypatch, hot):
    monkeypatch.setattr(lifecycle, "HOT", hot)
    monkeypatch.setattr(skew, "HOT", hot)
    counted = []
    by_counting = lifecycle._named_by_counting
    monkeypatch.setattr(lifecycle, "_named_by_counting", lambda ready: counted.append(1) or by_counting(ready))
    rng = random.Random(3)
    files = [(job, f"{rng.getrandbits(128):032x}", rng.choice(["a", "a-2", "a-2-2", "a-02"]), ".md")
             for job in range(40) for _ in range(2 if job % 2 else 9)]
    assert run(spark, files) == simulate(files)
    assert bool(counted) == (hot == 3)


def test_files_without_a_job_or_a_name(spark):
    df = spark.createDataFrame(
        [(None, "00", "x.html", "o/x.md"), (None, "01", "x.html", "o/y.md"), (None, "02", "x-2.html", "o/z.md"), (3, "03", None, "o/v.md")],
        "job_id long, file_id string, original_filename string, output_path string",
    )
    want = {"00": "x.md", "01": "x-2.md", "02": "x-2.md", "03": None}
    whole = bundle_names(df)
    assert {r.file_id: r.member_name for r in whole.collect()} == want
