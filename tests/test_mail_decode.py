"""Decoded mail leaves Python as Arrow arrays; each part type is read once."""

from email.message import Message

from tallyspark.sources import mail as M

RAW = (b"Subject: Alert\r\nFrom: a@b.example\r\nDate: d\r\nMIME-Version: 1.0\r\n"
       b'Content-Type: multipart/alternative; boundary="b1"\r\n\r\n'
       b"--b1\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nplain \xc3\xa9\r\n"
       b"--b1\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<b>html</b>\r\n"
       b"--b1\r\nContent-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\nA\r\n--b1--\r\n")


def test_a_part_type_is_read_once(monkeypatch):
    calls, real = [], Message.get_content_type

    def counted(self):
        import sys
        calls.append(sys._getframe(1).f_code.co_filename == M.__file__)
        return real(self)

    monkeypatch.setattr(Message, "get_content_type", counted)
    parts = M.decode_one(RAW)["parts"]
    assert [(p["kind"], p["attached"], p["text"]) for p in parts] == [
        ("text/plain", False, "plain é"), ("text/html", False, "<b>html</b>"), ("text/plain", True, None)]
    assert sum(calls) == len(parts)


def test_messages_and_dead_letters(spark):
    rows = [("1", "m1", RAW), ("1", "m2", None), (None, "m3", b""), ("2", "m4", b"Subject: x\r\n\r\nbody \xff"), ("2", "m4", None)]
    good, bad = M.split_dead_letters(M.parse_messages(spark.createDataFrame(rows, "account_id string, message_id string, content binary")))
    key = lambda rows: sorted(map(str, rows))
    assert key((r.account_id, r.message_id, r.subject, r.body) for r in good.collect()) == key(
        [("1", "m1", "Alert", "plain é"), (None, "m3", "", ""), ("2", "m4", "x", "body ÿ")])
    assert key(tuple(r) for r in bad.collect()) == key([("1", "m2", "missing content"), ("2", "m4", "missing content")])
    assert "MapInArrow" in M.decode_messages(spark.createDataFrame(rows, "account_id string, message_id string, content binary"))._jdf.queryExecution().toString()
