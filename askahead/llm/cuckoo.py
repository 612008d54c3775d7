"""A cuckoo filter over digests that keeps its keys, so that hits are verified and growth loses nothing."""

from __future__ import annotations

SLOTS, MAX_KICKS = 4, 200


class CuckooIndex:
    """Insert, find and delete digests (at least 8 bytes of uniform bits each).

    A digest's 16-bit print lies in one of two buckets of four slots. Each slot also points to its key, which a hit is
    compared with. When displacing prints finds no free slot, the table is built again at twice the size from the
    stored keys.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self.keys: list[bytes | None] = []
        self.free: list[int] = []
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.refs = [0] * (buckets * SLOTS)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    @staticmethod
    def _place(digest: bytes) -> tuple[int, int]:
        bits = int.from_bytes(digest[:8], "little")
        return (bits >> 48) or 1, bits & 0xFFFFFFFF

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, bucket = self._place(digest)
        bucket &= self.mask
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[self.refs[slot]] == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> int:
        """The number given to a live digest, or -1."""
        slot = self._slot(digest)
        return -1 if slot < 0 else self.refs[slot]

    def insert(self, digest: bytes) -> int:
        """Add a digest that is not in the index; returns its number, which deletion sets free."""
        if self.free:
            ref = self.free.pop()
            self.keys[ref] = digest
        else:
            ref = len(self.keys)
            self.keys.append(digest)
        if not self._put(digest, ref):
            self._grow()
        return ref

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.keys[self.refs[slot]] = None
        self.free.append(self.refs[slot])
        self.prints[slot] = 0
        return True

    def _put(self, digest: bytes, ref: int) -> bool:
        mark, bucket = self._place(digest)
        bucket &= self.mask
        for kick in range(MAX_KICKS):
            for b in (bucket, self._other(bucket, mark)):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.refs[slot] = mark, ref
                        return True
            slot = bucket * SLOTS + (kick * 7 + ref) % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            ref, self.refs[slot] = self.refs[slot], ref
            bucket = self._other(bucket, mark)
        return False

    def _grow(self) -> None:
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._put(key, ref) for ref, key in enumerate(self.keys) if key is not None):
                return
            buckets *= 2
