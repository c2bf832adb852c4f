"""U4: command framing as a table function for SQL users.

    SELECT * FROM frame_commands(TABLE(chunks) PARTITION BY session_id ORDER BY seq)

Spark partitions and orders the input; each partition's instance keeps only
the pieces of the unfinished record between rows and looks at every line once
(the same record rule as the batch and streaming framers).  One session is one
instance: sessions that hold a large share of all chunks belong to
``operators.framing.frame_commands(skew_safe=True)``.
"""

from __future__ import annotations

from pyspark.sql.functions import udtf

from drover.streaming.framing import Framer


@udtf(returnType="session_id BIGINT, record_no BIGINT, output STRING, exit_code INT")
class FrameCommands:
    def __init__(self):
        self.framer = Framer()
        self.record_no = 0

    def eval(self, row):
        for body, code in self.framer.feed(row["chunk"] or ""):
            yield row["session_id"], self.record_no, body, code
            self.record_no += 1
