"""Tails of logs against reading them whole."""

import io
import random

import pytest

from authsignal.sources.tails import lines_from_end, read_tails


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_lines_come_whole_from_the_end(block):
    draw = random.Random(block)
    texts = [b"", b"\n", b"a", b"a\n", b"\n\n", b"a\n\nb", b"\na"]
    texts += ["".join(draw.choice(["a", "é", "\n", "xyz"]) for _ in range(60)).encode() for _ in range(40)]
    for text in texts:
        got = [(position, line) for position, line, _ in lines_from_end(io.BytesIO(text), len(text), block)]
        want, at = [], 0
        for line in text.split(b"\n")[: -1 if text.endswith(b"\n") or not text else None]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want[::-1], text


def test_tails_of_rotated_logs(spark, tmp_path):
    whole = {}
    for source in ("amf", "ran"):
        for day in range(3):
            folder = tmp_path / "logs" / source / f"part{day}"  # rotation may use folders too
            folder.mkdir(parents=True, exist_ok=True)
            lines = [f"{source} {day} {k} {'reject' if k % 40 == 3 else 'fine'}" for k in range(100)]
            (folder / "a.log").write_text("\n".join(lines) + "\n")
            whole.setdefault(source, []).extend(lines)
    (tmp_path / "logs" / "empty").mkdir()
    (tmp_path / "logs" / "empty" / "x.log").write_text("")
    for pattern, count in (("", 10), ("reject", 5), ("reject", 1_000), ("nothing", 3)):
        got = {}
        for r in sorted(read_tails(spark, str(tmp_path / "logs"), count, pattern, 64).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.source, []).append(r.line)
        want = {s: [line for line in reversed(lines) if pattern in line][:count] for s, lines in whole.items()}
        assert got == {s: lines for s, lines in want.items() if lines}


def test_only_the_end_of_a_large_file_is_read(spark, tmp_path):
    folder = tmp_path / "big" / "amf"
    folder.mkdir(parents=True)
    line = "03/04 05:06:07.089: [amf] INFO: " + "x" * 100
    with open(folder / "amf.log", "w") as out:
        for k in range(200_000):
            out.write(f"{line} {k}\n")
    rows = read_tails(spark, str(tmp_path / "big"), 20).collect()
    assert [int(r.line.rsplit(" ", 1)[1]) for r in sorted(rows, key=lambda r: r["rank"])] == list(range(199_999, 199_979, -1))
    assert (folder / "amf.log").stat().st_size > 25_000_000 and rows[0].bytes_read <= 1 << 16
