"""HTTP requests over few connections: each host has a number of lanes, and a lane one connection that stays open."""

from __future__ import annotations

import http.client
from urllib.parse import urljoin, urlsplit

#: Redirects that are followed.
REDIRECTS = 10


class Connections:
    """Connections of one task by scheme, host and port."""

    def __init__(self) -> None:
        self.open: dict[tuple[str, str], http.client.HTTPConnection] = {}

    def _ask(self, url: str, headers: list[tuple[str, str]], timeout_ms: int) -> tuple[int, str | None, bytes]:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            raise ValueError(f"not an HTTP URL: {url}")
        key = parts.scheme, parts.netloc.rsplit("@", 1)[-1]
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        sent = dict(headers)  # of equal names the last counts, as a request holds one of each
        for again in (key in self.open, False):
            held = self.open.pop(key, None)
            if held is None:
                kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
                held = kind(key[1], timeout=timeout_ms / 1000)
            held.timeout = timeout_ms / 1000
            if held.sock is not None:
                held.sock.settimeout(held.timeout)
            try:
                held.request("GET", target, headers=sent)
                got = held.getresponse()
                out = got.status, got.headers.get("Location"), got.read()
            except (http.client.HTTPException, ConnectionError, BrokenPipeError):
                held.close()
                if not again:  # a connection that was kept may have been closed by the host meanwhile
                    raise
                continue
            except Exception:
                held.close()
                raise
            if not got.will_close:
                self.open[key] = held
            return out
        raise AssertionError

    def get(self, url: str, headers: list[tuple[str, str]], timeout_ms: int) -> bytes:
        """The content behind a URL; redirects are followed, and a status of 400 or more is an OSError."""
        for _ in range(REDIRECTS + 1):
            status, place, content = self._ask(url, headers, timeout_ms)
            if status in (301, 302, 303, 307, 308) and place:
                url = urljoin(url, place)
                continue
            if status >= 400:
                raise OSError(f"HTTP status {status}")
            return content
        raise OSError("too many redirects")

    def close(self) -> None:
        for held in self.open.values():
            held.close()
        self.open.clear()
