"""Mask ownership over pixels, a frame at a time: what the machine of runs is held against."""

import math

import numpy as np


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


def dist(a, b):
    return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


class Plain:
    """One game, a frame of pixels at a time."""

    def __init__(self, cfg):
        self.cfg = cfg
        self.mask_of, self.asked, self.since, self.lacking, self.rest, self.bad, self.birth = {}, [], {}, {}, {}, {}, {}
        self.dead, self.last, self.first, self.image, self.before, self.newcomers, self.out_of_time, self.opened, self.log = set(), {}, {}, None, [], [], [], False, []

    def part(self, box):
        x1, y1, x2, y2 = box
        px, py = (x2 - x1) * 0.2, (y2 - y1) * 0.2
        return slice(max(0, round(y1 - py)), min(self.cfg.frame_h, round(y2 + py))), slice(max(0, round(x1 - px)), min(self.cfg.frame_w, round(x2 + px)))

    def measure(self, mask, box):
        own = self.image == mask
        area = int(own[self.part(box)].sum())
        return area, area / max(1, int(own.sum()))

    def main_mask(self, box):
        if self.image is None:
            return None, 0
        crop = self.image[max(0, box[1]) : box[3], max(0, box[0]) : box[2]]
        counts = {m: int((crop == m).sum()) for m in sorted(set(crop.ravel().tolist()) - {0})}
        if not counts:
            return None, 0
        mask = max(counts, key=lambda m: (counts[m], -m))
        area, share = self.measure(mask, box)
        return (mask, counts[mask] / crop.size) if area >= self.cfg.mask_area and share >= self.cfg.mask_inside else (None, 0)

    def blocked(self, f, me, box, others):
        worst, who = -1, None
        for t, b in others:
            if t != me and (t in self.mask_of or f - self.birth.get(t, f) >= self.cfg.old_age):
                v, d = iou(box, b), dist(box, b)
                limit = max(self.cfg.block_px, 0.3 * max(box[3] - box[1], b[3] - b[1]))
                score = max(v / self.cfg.block_iou, limit / max(1, d))
                if (v >= self.cfg.block_iou or d <= limit) and score > worst:
                    worst, who = score, t
        if who is not None:
            self.since.setdefault(me, f)
            self.log.append((me, "defer", None, who, f - self.since[me]))
        return who is not None

    def inherits(self, me, box, visible):
        mask, fill = self.main_mask(box) if self.mask_of else (None, 0)
        if mask is None or fill < self.cfg.reuse_fill:
            return False
        owners = [t for t, m in self.mask_of.items() if m == mask]
        if owners[:1] == [me]:
            self.since.pop(me, None)
            return True
        if not owners or owners[0] in visible:
            return False
        self.mask_of.pop(owners[0])
        self.mask_of[me] = mask
        if me in self.asked:
            self.asked.remove(me)
        for d in (self.lacking, self.bad, self.since):
            d.pop(me, None)
        self.log.append((me, "reuse", mask, owners[0], None))
        return True

    def begin(self, f, rows, image):
        """Everything up to the referees: the players (id, box, confidence) that are left."""
        self.log = []
        players = [(r[3], tuple(r[5:9]), r[9]) for r in rows if not r[4]]
        referees = [(r[3], tuple(r[5:9]), r[9]) for r in rows if r[4]]
        here = [t for t, _, _ in players]
        expired = [t for t in self.last if f - self.last[t] > self.cfg.buffer and t not in here]
        arrivals = [t for t in here if t not in self.last or f - self.last[t] > self.cfg.buffer + 1]
        for t in expired:
            del self.last[t]
        for t in arrivals:
            self.first[t] = f
        for t in here:
            self.last[t] = f
        # Requests of the frame before, answered from this picture.
        grants = []
        if self.image is not None:
            if not self.opened:
                self.opened, grants = True, list(self.newcomers)
            else:
                old = dict(self.before)
                for t in self.newcomers:
                    if t in old and not self.inherits(t, old[t], old) and not self.blocked(f, t, old[t], self.before):
                        self.since.pop(t, None)
                        grants.append(t)
                keep = []
                for t in list(dict.fromkeys(self.asked + list(self.since))):
                    if t not in old or t in self.mask_of:
                        self.since.pop(t, None)
                    elif not self.inherits(t, old[t], old) and not self.blocked(f, t, old[t], self.before):
                        self.since.pop(t, None)
                        keep.append(t)
                self.asked = keep
                grants += [t for t in keep if t not in grants]
        for t in self.out_of_time:
            if t in self.mask_of:
                self.dead.add(self.mask_of.pop(t))
        self.image = image.copy()
        for m in self.dead:
            self.image[self.image == m] = 0
        self.asked = []
        for t in grants:
            mask, _ = self.main_mask(dict(self.before)[t])
            if mask is None or mask in self.mask_of.values():
                self.asked.append(t)
            else:
                self.mask_of[t] = mask
                self.log.append((t, "answer", mask, None, None))
        # Copies of a mask's player.
        groups = {}
        for t, b, _ in players:
            mask, fill = self.main_mask(b)
            if mask is not None and fill >= self.cfg.mask_fill:
                groups.setdefault(mask, []).append((self.first[t], t, b))
        dropped = set()
        for mask, members in groups.items():
            members.sort()
            for _, t, b in members[1:]:
                if iou(members[0][2], b) >= self.cfg.dup_iou or dist(members[0][2], b) <= self.cfg.dup_dist:
                    dropped.add(t)
                    self.log.append((t, "duplicate", mask, members[0][1], None))
        players = [p for p in players if p[0] not in dropped]
        visible = [t for t, _, _ in players]
        # Frames without a mask.
        for t in list(self.lacking):
            if t not in visible:
                del self.lacking[t]
        for t in list(self.rest):
            self.rest[t] -= 1
            if self.rest[t] == 0:
                del self.rest[t]
        for t, b, _ in players:
            if t in self.mask_of:
                self.lacking.pop(t, None)
                self.since.pop(t, None)
            elif t not in self.rest:
                self.lacking[t] = self.lacking.get(t, 0) + 1
                if self.lacking[t] >= self.cfg.reinit_missing and t not in self.asked:
                    if not self.inherits(t, b, visible) and not self.blocked(f, t, b, [(u, c) for u, c, _ in players]):
                        self.asked.append(t)
                        self.rest[t] = self.cfg.reinit_cooldown
                        self.log.append((t, "request", None, None, self.lacking[t]))
        # Referees.
        shown = []
        for t, b, conf in players:
            surer = [r for r, rb, rc in referees if iou(b, rb) >= self.cfg.ref_iou and rc >= conf + self.cfg.ref_conf_gain]
            mask, fill = self.main_mask(b)
            if surer and mask is not None and fill >= self.cfg.ref_fill:
                self.image[self.image == mask] = 0
                self.log.append((t, "conflict", mask, surer[0], None))
            else:
                shown.append((t, b, conf))
        self.pending = f, players, arrivals, expired
        return shown

    def look(self, shown):
        """The players' masks as pictures of their own; those that have come off go."""
        seen = {}
        for t, b, *_ in shown:
            if t not in self.mask_of:
                continue
            mask = self.mask_of[t]
            area, share = self.measure(mask, b)
            if area >= self.cfg.mask_area and share >= self.cfg.mask_inside:
                self.bad.pop(t, None)
                self.lacking.pop(t, None)
                own = np.zeros_like(self.image, bool)
                own[self.part(b)] = (self.image == mask)[self.part(b)]
                seen[t] = own
                continue
            self.bad[t] = self.bad.get(t, 0) + 1
            tiny = area < self.cfg.mask_area
            if t not in self.rest and (tiny and self.bad[t] >= self.cfg.reinit_area or not tiny and share <= self.cfg.reinit_ratio and self.bad[t] >= self.cfg.reinit_inside):
                self.log.append((t, "invalidate", mask, None, self.bad[t]))
                del self.mask_of[t], self.bad[t]
                self.dead.add(mask)
                self.image[self.image == mask] = 0
                if t not in self.asked:
                    self.asked.append(t)
                self.lacking[t], self.rest[t] = 0, self.cfg.reinit_cooldown
        return seen

    def end(self):
        f, players, arrivals, expired = self.pending
        for t, _, _ in players:
            self.birth.setdefault(t, f)
        for t in expired:
            self.birth.pop(t, None)
        visible = {t for t, _, _ in players}
        self.before, self.newcomers, self.out_of_time = [(t, b) for t, b, _ in players], [t for t in arrivals if t in visible], expired

    def frame(self, f, rows, image):
        shown = self.begin(f, rows, image)
        self.look(shown)
        self.end()
        return [(*e, None) for e in self.log] + [(t, "state", self.mask_of.get(t), None, self.lacking.get(t, 0), f - self.since[t] if t in self.since else None) for t, _, _ in shown]
