"""A command line that builds a stream: python -m voxelweave.cli -d W H D -f RATE -o FILE [-g GOP] [-b GROUP] [-m 0|1]

Commands: e_nvdb PATH, e_vox PATH, b X0 Y0 Z0 X1 Y1 Z1 (box), a LR UD FB (axes, for e_nvdb), r 0|1 (remove hidden voxels), f (finish), q (abort).
"""

from __future__ import annotations

import argparse
import shlex
import sys
from collections.abc import Iterable

from .api import VoxelEncoder
from .operators.volumes import checked_dims


class Session:
    """The encoder and what the commands before have set."""

    def __init__(self, encoder: VoxelEncoder):
        self.encoder, self.axes, self.hidden = encoder, ("x", "y", "z"), False
        self.box = ((0, 0, 0), tuple(n - 1 for n in encoder.dims))

    def run(self, line: str) -> bool:
        """Runs one command; False when the stream is finished or aborted."""
        words = shlex.split(line)
        if not words:
            return True
        name, *args = words
        if name == "e_nvdb":
            self.encoder.encode_nvdb_frame(args[0], self.box, self.axes, self.hidden)
        elif name == "e_vox":
            self.encoder.encode_vox_frame(args[0], self.box, self.hidden)
        elif name == "b":
            n = list(map(int, args))
            if len(n) != 6:
                raise ValueError("a box has six numbers")
            checked_dims(*(h - low + 1 for low, h in zip(n[:3], n[3:], strict=True)))
            self.box = tuple(n[:3]), tuple(n[3:])
        elif name == "a":
            if sorted(args) != ["x", "y", "z"]:
                raise ValueError("axes are x, y and z in some order")
            self.axes = tuple(args)
        elif name == "r":
            self.hidden = args[0].lower() in ("1", "true", "on")
        elif name == "f":
            self.encoder.finish()
            return False
        elif name == "q":
            self.encoder.abort()
            return False
        else:
            raise ValueError(f"unknown command {name}")
        return True


def parsed(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-d", nargs=3, type=int, required=True)
    p.add_argument("-f", type=float, required=True)
    p.add_argument("-g", type=int, default=1)
    p.add_argument("-b", type=int, default=256)
    p.add_argument("-m", default="1", choices=["0", "1", "true", "false", "on", "off"])
    p.add_argument("-o", required=True)
    return p.parse_args(args)


def main(args: list[str], lines: Iterable[str]) -> None:
    from .session import local_session

    a = parsed(args)
    session = Session(VoxelEncoder(local_session("voxelweave-cli"), *a.d, a.f, a.g, a.b, a.m in ("1", "true", "on"), a.o))
    for line in lines:
        try:
            if not session.run(line):
                return
        except (ValueError, IndexError) as e:
            print(f"error: {e}", file=sys.stderr)
    session.encoder.abort()


if __name__ == "__main__":
    main(sys.argv[1:], sys.stdin)
