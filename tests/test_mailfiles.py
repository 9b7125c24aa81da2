"""The splitting mail source against the plain parse of whole files."""

import io
import random
import re
import zipfile
from email.message import EmailMessage

import pytest

from folioframe.sources import mailbox
from folioframe.sources.mailfiles import raw_messages, split_mbox


def mail(k: int, rng: random.Random) -> bytes:
    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"] = f"Ana Lo <a{k % 7}@x.example>", "b@y.example", f"Ünder {k}", f"<m{k}@x>"
    m["Date"] = f"Mon, 0{k % 9 + 1} Jan 2024 10:00:00 +0100"
    text = "\n".join("word " * rng.randrange(12) for _ in range(rng.randrange(1, 9))) + f"\nFrom here on {k}\n"
    if k % 4 == 0:
        m.set_content(text)
    elif k % 4 == 1:
        m.set_content(f"<html><head><style>p {{}}</style></head><body><p>{text}</p><ul><li>one</li></ul></body></html>", subtype="html")
    elif k % 4 == 2:
        m.set_content(text)
        m.add_alternative(f"<p>{text}</p>", subtype="html")
        m.add_attachment(b"x" * rng.randrange(3000), maintype="application", subtype="octet-stream", filename=f"f{k}.bin")
    else:
        m.set_content(f"{text}\nFrom: Eva <e@x.example>\nSent: Monday\nTo: Ana\nSubject: before\n\nold text")
    return m.as_bytes()


def boxed(mails: list[bytes]) -> bytes:
    return b"".join(b"From a@x.example Mon Jan  1 10:00:00 2024\n" + m.replace(b"\n\nFrom ", b"\n\n>From ") + b"\n" for m in mails)


@pytest.mark.parametrize("split, chunk", [(64, 16), (1000, 64), (4096, 1 << 20)])
def test_ranges_of_a_mailbox_give_each_message_once(split, chunk):
    rng = random.Random(split)
    box = boxed([mail(k, rng) for k in range(60)]) + b"From x Mon Jan  1 09:00:00 2024\nlast, without an end"
    lines = [m.span() for m in re.finditer(rb"(?:\A|(?<=\n\n))From \S+ +(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b[^\n]*\n", box)]
    whole = [box[a : b - 1] for (_, a), (b, _) in zip(lines, [*lines[1:], (len(box) + 1, 0)])]
    assert len(whole) == 61
    got = [m for start in range(0, len(box), split) for m in split_mbox(io.BytesIO(box), start, min(len(box), start + split), chunk)]
    assert [c for _, c in got] == whole
    assert all(box[at : at + 5] == b"From " for at, _ in got)


def test_one_mailbox_and_one_archive_are_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    mails = [mail(k, rng) for k in range(3000)]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.mbox").write_bytes(boxed(mails[:2400]))
    with zipfile.ZipFile(tmp_path / "in" / "deep" / "b.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(2300, 2900):
            z.writestr(f"x/{k}.eml", mails[k])
        z.writestr("inner.zip", b"")
        z.writestr("note.txt", b"")
    for k in range(2900, 3000):
        (tmp_path / "in" / f"{k}.eml").write_bytes(mails[k])
    (tmp_path / "in" / ".hidden.eml").write_bytes(mails[0])
    raw = raw_messages(spark, str(tmp_path / "in"), split=100_000)
    assert raw.rdd.getNumPartitions() > 20 and raw.count() == 2400 + 600 + 100
    got = {r["message_id"]: r.asDict(True) for r in mailbox.load_emails(spark, f"file://{tmp_path}/in/", split=100_000).collect()}
    assert len(got) == 3000
    for k in range(0, 3000, 7):
        data = boxed([mails[k]]).split(b"\n", 1)[1][:-1] if k < 2400 else mails[k]
        want = mailbox.parse_message(data, got[f"<m{k}@x>"]["source_file"])
        assert got[f"<m{k}@x>"] == want
    assert got["<m1@x>"]["new_text"].startswith("word") or "From here on 1" in got["<m1@x>"]["new_text"]
    assert "- one" in got["<m5@x>"]["body_raw"] and got["<m6@x>"]["attachment_names"] == ["f6.bin"] and got["<m7@x>"]["quoted_text"].endswith("old text")
    # the first of equal ids in the order of paths: the archive's copies of mails 2300 to 2399 come after the mailbox
    assert "a.mbox#" in got["<m2350@x>"]["source_file"]


def test_files_of_a_told_kind_and_none(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(boxed([mail(0, random.Random(1))]))
    assert raw_messages(spark, str(tmp_path), kind="mbox").count() == 1
    assert raw_messages(spark, str(tmp_path)).count() == 0
