"""A streaming data source for a serial port that talks the line protocol.

``spark.dataSource.register(SerialSource)`` and ``readStream.format("serial_lines")``
with options port (or "auto"), baud, banner_timeout. pyserial is needed only when
a stream starts; any object with its methods can be passed in tests by ``opener``.
"""

from __future__ import annotations

import time

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def find_port(ports: list[str]) -> str:
    """The first port whose name holds "usb"."""
    for port in ports:
        if "usb" in port.lower():
            return port
    raise SystemExit("no USB serial port")


def handshake(device, timeout: float = 5.0, clock=time.monotonic) -> bool:
    """Wait for a line that starts with # and send g; False if none came in time (streaming starts all the same)."""
    until, seen = clock() + timeout, False
    while not seen and clock() < until:
        seen = device.readline().strip().startswith(b"#")
    device.write(b"g")
    return seen


def drain(device) -> list[str]:
    """All lines that are waiting."""
    out = []
    while device.in_waiting:
        line = device.readline().strip()
        if line:
            out.append(line.decode("utf-8", "replace"))
    return out


def stop(device) -> None:
    device.write(b"s")
    device.close()


class SerialReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.device, self.kept = options, None, []

    def _open(self):
        import serial
        from serial.tools import list_ports

        port = self.options.get("port", "auto")
        port = find_port([p.device for p in list_ports.comports()]) if port == "auto" else port
        device = serial.Serial(port, int(self.options.get("baud", 115200)), timeout=1)
        handshake(device, float(self.options.get("banner_timeout", 5)))
        return device

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict):
        self.device = self.device or self._open()
        first = start["line"]
        lines = [(first + k, line) for k, line in enumerate(drain(self.device))]
        self.kept += lines
        return iter(lines), {"line": first + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([x for x in self.kept if start["line"] <= x[0] < end["line"]])

    def commit(self, end: dict) -> None:
        self.kept = [x for x in self.kept if x[0] >= end["line"]]


class SerialSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "serial_lines"

    def schema(self) -> str:
        return "seq long, value string"

    def simpleStreamReader(self, schema) -> SerialReader:
        return SerialReader(self.options)
