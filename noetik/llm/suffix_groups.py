"""Suffix array construction by linear grouping, and its compiled form.

Phase 1 orders suffixes by their Lyndon prefixes. Groups start as first bytes and are processed in descending order. A
suffix's previous-smaller pointer is the nearest position before it whose group is lower; walking pointers of processed
suffixes finds it, and each is walked over once. The pointers' targets are parents: inside their own group, those with
more children in the processed group are larger, so they move behind the rest as new groups. A processed group is final.

Phase 2 emits: suffixes of one group differ only in what follows their Lyndon prefix, the next smaller suffix, so
walking the array from its start, each suffix places those whose next smaller suffix it is at the front of their groups.

construct() is the plain Python form. SOURCE does the same for executors, and then finds the windows that occur earlier:
neighbours in the array that share so many bytes hold equal windows, of which the earliest stays.
"""

from __future__ import annotations

CLASS = "NoetikSuffixGroups"
SOURCE = """
public class NoetikSuffixGroups implements org.apache.spark.sql.api.java.UDF3, java.io.Serializable {
    public NoetikSuffixGroups() {}

    static int[] construct(byte[] text) {
        int n = text.length;
        int[] sa = new int[n], start = new int[n], place = new int[n], end = new int[n], prev = new int[n], moved = new int[n];
        int[] first = new int[257];
        for (int i = 0; i < n; i++) first[(text[i] & 255) + 1]++;
        for (int c = 0; c < 256; c++) first[c + 1] += first[c];
        int[] next = new int[256];
        for (int c = 0; c < 256; c++) {
            next[c] = first[c];
            if (first[c] < first[c + 1]) end[first[c]] = first[c + 1];
        }
        for (int i = 0; i < n; i++) {
            int c = text[i] & 255;
            sa[next[c]] = i;
            place[i] = next[c]++;
            start[i] = first[c];
        }
        int[] parent = new int[16], copies = new int[16], old = new int[16];
        int high = n;
        while (high > 0) {
            int g = start[sa[high - 1]];
            java.util.Arrays.sort(sa, g, high);
            if (high - g > parent.length) {
                int size = Math.min(n, 2 * (high - g));
                parent = new int[size];
                copies = new int[size];
                old = new int[size];
            }
            int m = 0, most = 0;
            for (int k = g; k < high; k++) {
                int i = sa[k], j = i - 1;
                while (j >= 0 && start[j] >= g) j = prev[j];
                prev[i] = j;
                if (j < 0) continue;
                if (m > 0 && parent[m - 1] == j) copies[m - 1]++;
                else {
                    parent[m] = j;
                    copies[m++] = 1;
                }
                if (copies[m - 1] > most) most = copies[m - 1];
            }
            int[] from = new int[most + 2];  // parents by their number of children, most first
            for (int x = 0; x < m; x++) from[most - copies[x] + 1]++;
            for (int x = 1; x <= most + 1; x++) from[x] += from[x - 1];
            for (int x = 0; x < m; x++) old[x] = parent[x];
            int[] put = java.util.Arrays.copyOf(from, most + 1);
            for (int x = 0; x < m; x++) parent[put[most - copies[x]]++] = old[x];
            for (int level = most; level > 0; level--) {
                int low = from[most - level], here = from[most - level + 1];
                for (int x = low; x < here; x++) {
                    int p = parent[x], s = start[p], e = --end[s], q = sa[e], at = place[p];
                    sa[at] = q;
                    place[q] = at;
                    sa[e] = p;
                    place[p] = e;
                    moved[s]++;
                    old[x] = s;
                }
                for (int x = low; x < here; x++) {
                    int s = old[x], fresh = end[s];
                    if (fresh != s) {
                        start[parent[x]] = fresh;
                        end[fresh] = fresh + moved[s];
                    }
                }
                for (int x = low; x < here; x++) {
                    int s = old[x];
                    if (moved[s] > 0 && end[s] == s) end[s] = s + moved[s];
                    moved[s] = 0;
                }
            }
            high = g;
        }
        int[] front = place;
        for (int i = 0; i < n; i++) front[start[i]] = start[i];
        int[] out = end;
        for (int i = n - 1; i >= 0; i = prev[i]) out[front[start[i]]++] = i;
        for (int k = 0; k < n; k++) {
            int j = out[k];
            for (int i = j - 1; i >= 0 && i != prev[j]; i = prev[i]) out[front[start[i]]++] = i;
        }
        return out;
    }

    /** The suffix array; the sign bit marks a suffix that shares at least need bytes with the one before it. */
    static int[] marked(byte[] text, int need) {
        int n = text.length;
        int[] sa = construct(text), rank = new int[n];
        for (int k = 0; k < n; k++) rank[sa[k]] = k;
        int[] out = new int[n];
        int h = 0;
        for (int i = 0; i < n; i++) {
            int k = rank[i], v = i;
            if (k > 0) {
                int j = sa[k - 1];
                while (i + h < n && j + h < n && text[i + h] == text[j + h]) h++;
                if (h >= need) v |= 0x80000000;
                if (h > 0) h--;
            } else h = 0;
            out[k] = v;
        }
        return out;
    }

    /** Of stretches (n windows each, at pos in doc, of a block): by block, the windows of need bytes that are earlier elsewhere. */
    public Object call(Object input, Object rows, Object least) throws Exception {
        byte[] text = (byte[]) input;
        int need = ((Integer) least).intValue();
        java.nio.ByteBuffer meta = java.nio.ByteBuffer.wrap((byte[]) rows).order(java.nio.ByteOrder.LITTLE_ENDIAN);
        int m = meta.limit() / 40;
        long[] doc = new long[m], pos = new long[m], block = new long[m];
        int[] windows = new int[m], begin = new int[m], of = new int[text.length];
        int at = 0;
        for (int s = 0; s < m; s++) {
            doc[s] = meta.getLong(40 * s + 8);
            pos[s] = meta.getLong(40 * s + 16);
            windows[s] = (int) meta.getLong(40 * s + 24);
            block[s] = meta.getLong(40 * s + 32);
            begin[s] = at;
            for (int k = 0; k < windows[s] + need - 1; k++) of[at++] = s;
        }
        int[] sa = marked(text, need);
        boolean[] late = new boolean[text.length];
        int n = text.length;
        for (int k = 0; k < n; ) {
            int e = k + 1;
            while (e < n && sa[e] < 0) e++;
            if (e - k > 1) {
                int best = -1;
                for (int x = k; x < e; x++) {
                    int i = sa[x] & 0x7fffffff, s = of[i], o = i - begin[s];
                    if (o >= windows[s]) continue;
                    if (best >= 0) {
                        int bs = of[best];
                        long bp = pos[bs] + best - begin[bs], p = pos[s] + o;
                        boolean earlier = doc[s] < doc[bs] || doc[s] == doc[bs] && p < bp;
                        late[earlier ? best : i] = true;
                        if (!earlier) continue;
                    }
                    best = i;
                }
            }
            k = e;
        }
        java.util.TreeMap found = new java.util.TreeMap();
        for (int s = 0; s < m; s++) {
            for (int o = 0; o < windows[s]; ) {
                int e = o;
                while (e < windows[s] && late[begin[s] + e]) e++;
                if (e > o) {
                    Integer key = Integer.valueOf((int) block[s]);
                    java.io.ByteArrayOutputStream to = (java.io.ByteArrayOutputStream) found.get(key);
                    if (to == null) {
                        to = new java.io.ByteArrayOutputStream();
                        found.put(key, to);
                    }
                    java.nio.ByteBuffer row = java.nio.ByteBuffer.allocate(24).order(java.nio.ByteOrder.LITTLE_ENDIAN);
                    row.putLong(doc[s]);
                    row.putLong(pos[s] + o);
                    row.putLong((long) (e - o));
                    to.write(row.array(), 0, 24);
                }
                o = Math.max(e, o + 1);
            }
        }
        java.util.ArrayList out = new java.util.ArrayList();
        java.util.Iterator each = found.entrySet().iterator();
        while (each.hasNext()) {
            java.util.Map.Entry e = (java.util.Map.Entry) each.next();
            out.add(org.apache.spark.sql.RowFactory.create(new Object[] {e.getKey(), ((java.io.ByteArrayOutputStream) e.getValue()).toByteArray()}));
        }
        return out;
    }
}
"""


def construct(text: bytes) -> list[int]:
    """The suffix array; the shorter of two suffixes, one of which begins with the other, comes first."""
    n = len(text)
    sa = sorted(range(n), key=text.__getitem__)
    first = {}
    for k, i in enumerate(sa):
        first.setdefault(text[i], k)
    start = [first[c] for c in text]
    place = [0] * n
    for k, i in enumerate(sa):
        place[i] = k
    end = {s: s + text.count(c) for c, s in first.items()}
    prev = [-1] * n
    high = n
    while high:
        g = start[sa[high - 1]]
        sa[g:high] = members = sorted(sa[g:high])
        copies: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and start[j] >= g:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                copies[j] = copies.get(j, 0) + 1
        for level in sorted(set(copies.values()), reverse=True):
            moved: dict[int, list[int]] = {}
            for p, c in copies.items():
                if c == level:
                    s = start[p]
                    end[s] -= 1
                    q, at = sa[end[s]], place[p]
                    sa[at], place[q], sa[end[s]], place[p] = q, at, p, end[s]
                    moved.setdefault(s, []).append(p)
            for s, own in moved.items():
                fresh = end[s]
                end[fresh] = fresh + len(own)
                for p in own:
                    start[p] = fresh
        high = g
    front = list(range(n))
    out = [0] * n

    def emit(i: int, stop: int) -> None:
        while i >= 0 and i != stop:
            out[front[start[i]]] = i
            front[start[i]] += 1
            i = prev[i]

    emit(n - 1, -1)
    for k in range(n):
        emit(out[k] - 1, prev[out[k]])
    return out
