"""The brakes of a run as keyed state: spend with a reserve for the writer, attempts per subtask, repeated scripts.

State of a run: tokens spent so far, executions per subtask, and the first place of every script fingerprint of a subtask.  A micro-batch
brings a run's rows in any order; they are taken by ``seq``, so files may be cut anywhere and arrive in any order that keeps a run's own order.
Each batch reads the state it needs once and writes what has changed, in the same transaction as its output; a replayed batch
starts from the state before it, and the sink overwrites the batch's own folder, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WRITER = "redactor"  # fixed value: the agent that may use the reserve
OUTPUT = "seq long, tipo string, agente string, subtarea string, disponible long, bloqueada int, intento long, repetida int"


class RunGuard(StatefulProcessor):
    """Rows ``seq, tipo, agente, subtarea, tokens, huella`` of one run to what the brakes say at each of them."""

    def __init__(self, keys: list[str], budget: int, reserve: int):
        self.keys, self.budget, self.reserve = keys, budget, reserve

    def init(self, handle) -> None:
        self.spent = handle.getValueState("spent", "tokens long")
        self.attempts = handle.getMapState("attempts", "subtarea string", "n long")
        self.scripts = handle.getMapState("scripts", "subtarea string, huella string", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - names given by the interface
        spent = self.spent.get()[0] if self.spent.exists() else 0
        attempts: dict[str, int] = {}
        scripts: dict[tuple, bool] = {}
        made = []
        for r in sorted(rows, key=lambda r: r["seq"]):
            left = intento = repetida = None
            if r["tipo"] == "llamada":
                left = self.budget - (0 if r["agente"] == WRITER else self.reserve) - spent
                spent += r["tokens"] or 0
            elif r["tipo"] == "ejecucion":
                task, script = (r["subtarea"],), (r["subtarea"], r["huella"])
                if r["subtarea"] not in attempts:
                    attempts[r["subtarea"]] = self.attempts.getValue(task)[0] if self.attempts.containsKey(task) else 0
                attempts[r["subtarea"]] += 1
                intento = attempts[r["subtarea"]]
                known = scripts[script] if script in scripts else self.scripts.containsKey(script)
                repetida = int(known)
                if not known:
                    self.scripts.updateValue(script, (r["seq"],))
                scripts[script] = True
            else:
                continue
            own = dict(zip(self.keys, key, strict=True))
            made.append(Row(**own, seq=r["seq"], tipo=r["tipo"], agente=r["agente"], subtarea=r["subtarea"], disponible=left,
                            bloqueada=None if left is None else int(left <= 0), intento=intento, repetida=repetida))
        self.spent.update((spent,))
        for task, n in attempts.items():
            self.attempts.updateValue((task,), (n,))
        yield from made

    def close(self) -> None:
        pass


def guarded(rows: DataFrame, keys: list[str], budget: int, reserve: int) -> DataFrame:
    """What the brakes say at each call and execution of a stream of trace rows."""
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + OUTPUT
    wanted = rows.select(*keys, "seq", "tipo", "agente", "subtarea", "tokens", "huella")
    return wanted.groupBy(*keys).transformWithState(statefulProcessor=RunGuard(keys, budget, reserve), outputStructType=schema, outputMode="Append", timeMode="None")


class rocks_state:  # noqa: N801 - used like a function
    """Keyed state needs the RocksDB store; the session's own choice comes back afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, None

    def __enter__(self):
        self.before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *error):
        self.spark.conf.set(PROVIDER, self.before) if self.before else self.spark.conf.unset(PROVIDER)
