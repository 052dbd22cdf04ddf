"""Own transcripts: k1 sets rules, k2 changes and confirms, k3 restores and contradicts, k0 is logistics only."""

TURNS = [
    ("k1", 1, None, "Nadia Brook", "Thanks everyone, I'm so happy to see this moving."),
    ("k1", 2, None, "Omar Lind", "The export must keep the last thirty days of invoices; the archive must store every signed contract."),
    ("k1", 3, None, "Nadia Brook", "A branch manager can approve refunds up to 200 dollars within 24 hours."),
    ("k1", 4, None, "Omar Lind", "We haven't decided on the refund window for gift vouchers."),
    ("k1", 5, None, "Nadia Brook", "The dashboard should just feel effortless."),
    ("k1", 6, None, "Omar Lind", "Yes, same idea as before."),
    ("k1", 7, None, "Nadia Brook", "I'll send the notes and a calendar invite after this call."),
    ("k1", 8, None, "Omar Lind", "High tickets are answered in four hours, medium tickets in two days, low tickets in five days."),
    ("k2", 1, "00:00:01.000", "Nadia Brook", "Small change: a branch manager can approve refunds up to 300 dollars within 24 hours."),
    ("k2", 2, "00:00:09.500", "Omar Lind", "The export stays as it is, it must keep the last thirty days of invoices."),
    ("k2", 3, "00:00:12.000", None, "High tickets are now answered in three hours."),
    ("k3", 1, None, "Omar Lind", "The refund window for gift vouchers is sixty days after purchase."),
    ("k3", 2, None, "Nadia Brook", "A branch manager can approve refunds within 48 hours at the counter."),
    ("k0", 1, None, "Nadia Brook", "Can we move the review meeting to Thursday at 3 pm?"),
    ("k0", 2, None, "Omar Lind", "Same time next week works for me."),
]
SCHEMA = "source_id string, line_no int, ts string, speaker string, text string"
VTT = """WEBVTT

1
00:00:01.000 --> 00:00:03.000
<v Nadia Brook>The export keeps the last thirty days.</v>

2
00:00:04.500 --> 00:00:06.000
<v>Is that for every branch?</v>

NOTE a remark of the editor

3
00:00:07.000 --> 00:00:09.000
<v Omar Lind>Yes, for every branch,
and for the archive.</v> <v Nadia Brook>Agreed.</v>

4
00:00:11.000 --> 00:00:12.000
42
"""
