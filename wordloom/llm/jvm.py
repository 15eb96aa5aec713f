"""The comparison of images on the JVM: a function for Spark SQL, compiled by the compiler that Spark compiles its own plans with."""

from __future__ import annotations

import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: The function takes a cell: an array of (id, members, pixel_hash, rows, part) in this order. It compares all pairs of its images (of two
#: parts: one of each) by the rule of media.agree with its order of ties, and gives rows (a, b, pixel_hash, links, x, y): what the links
#: connect (a, b: least of what is connected) and their number for each image. Pairs that rounding could decide aren't counted; they are
#: given both ways with their members (x, y) for the rule itself.
_SOURCE = r"""
package wordloom;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.ArrayList;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.api.java.UDF1;

public class ImagePairs implements UDF1 {
    private static final long serialVersionUID = 1L;
    private static final int RECORD = %(record)d, MOST = %(most)d, LEAST = %(least)d, TILE = 64;
    private static final double SHARE = %(share)r, TOLERANCE = %(tolerance)r;

    /**
     * For n corners of an image (words from s on) and those of other images (their words, in four arrays, from..to; image r has
     * at[r]..at[r + 1]): the nearest for each corner and other image (row), and for each other corner (back), as distance and number.
     */
    private static void nearest(long[] a, int s, int n, long[] b, long[] c, long[] d, long[] e, int[] at, int first, int last, int[] far, int[][] row, int[] back) {
        int from = at[first], width = at[last] - from;
        for (int q = 0; q < width; q++) back[q] = Integer.MAX_VALUE;
        for (int i = 0; i < n; i++) {
            distances(a[4 * (s + i)], a[4 * (s + i) + 1], a[4 * (s + i) + 2], a[4 * (s + i) + 3], b, c, d, e, from, width, far);
            least(far, i, width, back);
            rows(far, at, first, last, row[i]);
        }
    }

    private static void distances(long u, long v, long w, long x, long[] b, long[] c, long[] d, long[] e, int from, int width, int[] far) {
        for (int q = 0; q < width; q++)
            far[q] = (Long.bitCount(u ^ b[from + q]) + Long.bitCount(v ^ c[from + q]) + Long.bitCount(w ^ d[from + q]) + Long.bitCount(x ^ e[from + q])) << 16;
    }

    /** Without Math.min, which the JIT doesn't turn into vectors here. */
    private static void least(int[] far, int i, int width, int[] back) {
        for (int q = 0; q < width; q++) {
            int less = far[q] + i - back[q];
            back[q] += less & (less >> 31);
        }
    }

    private static void rows(int[] far, int[] at, int first, int last, int[] own) {
        for (int r = first; r < last; r++) {
            int from = at[r] - at[first], to = at[r + 1] - at[first], least = Integer.MAX_VALUE;
            for (int q = from; q < to; q++) least = Math.min(least, far[q] + q);
            own[r - first] = least - from;
        }
    }

    /** 1: least of n matches (x, y) to (u, v) agree on a transform, -1: they don't, 0: too close to tell. */
    private static int agreeing(double[] x, double[] y, double[] u, double[] v, int n, double least, double e) {
        double in = (TOLERANCE - e) * (TOLERANCE - e), out = (TOLERANCE + e) * (TOLERANCE + e);
        int found = -1;
        for (int p = 0; p < n; p++) {
            for (int q = p + 1; q < n; q++) {
                double dx = x[q] - x[p], dy = y[q] - y[p], far = dx * dx + dy * dy;
                if (far <= (6 - e) * (6 - e)) continue;
                double du = u[q] - u[p], dv = v[q] - v[p], c = (du * dx + dv * dy) / far, s = (dv * dx - du * dy) / far, scale = c * c + s * s;
                if (scale <= (0.4 - e) * (0.4 - e) || scale >= (2.5 + e) * (2.5 + e)) continue;
                int near = 0, sure = 0;
                for (int k = 0; k < n && near + n - k >= least; k++) {
                    double zx = x[k] - x[p], zy = y[k] - y[p], ex = c * zx - s * zy + u[p] - u[k], ey = s * zx + c * zy + v[p] - v[k], error = ex * ex + ey * ey;
                    if (error <= out) near++;
                    if (error <= in) sure++;
                }
                if (near < least) continue;
                if (sure >= least && far > (6 + e) * (6 + e) && scale > (0.4 + e) * (0.4 + e) && scale < (2.5 - e) * (2.5 - e)) return 1;
                found = 0;
            }
        }
        return found;
    }

    private static int root(int[] above, int i) {
        while (above[i] != i) {
            above[i] = above[above[i]];
            i = above[i];
        }
        return i;
    }

    public Object call(Object cell) {
        ArrayList rows = new ArrayList();
        scala.collection.Iterator it = ((scala.collection.Seq) cell).iterator();
        int total = 0, corners = 1, first = Integer.MAX_VALUE, last = Integer.MIN_VALUE;
        while (it.hasNext()) {
            Row r = (Row) it.next();
            int own = ((byte[]) r.get(1)).length / RECORD, part = r.getInt(4);
            rows.add(r);
            total += own;
            corners = Math.max(corners, own);
            first = Math.min(first, part);
            last = Math.max(last, part);
        }
        int n = rows.size(), lefts = 0, rights = 0;
        int[] start = new int[n + 1], above = new int[n], left = new int[n], right = new int[n];
        long[] words = new long[4 * total], size = new long[n], links = new long[n];
        double[] px = new double[total], py = new double[total];
        double reach = 0;
        for (int i = 0; i < n; i++) {
            Row r = (Row) rows.get(i);
            byte[] data = (byte[]) r.get(1);
            ByteBuffer at = ByteBuffer.wrap(data).order(ByteOrder.LITTLE_ENDIAN);
            int own = data.length / RECORD;
            for (int k = 0; k < own; k++) {
                int to = start[i] + k;
                px[to] = at.getFloat(k * RECORD);
                py[to] = at.getFloat(k * RECORD + 4);
                reach = Math.max(reach, Math.max(Math.abs(px[to]), Math.abs(py[to])));
                for (int w = 0; w < 4; w++) words[4 * to + w] = at.getLong(k * RECORD + 12 + 8 * w);
            }
            start[i + 1] = start[i] + own;
            above[i] = i;
            size[i] = r.getLong(3);
            if (own < LEAST) continue;
            if (r.getInt(4) == first) left[lefts++] = i;
            else right[rights++] = i;
        }
        boolean between = first != last;  // each part has a cell of its own besides
        if (!between) {
            right = left;
            rights = lefts;
        }
        double e = 1e-9 * (1 + reach);
        int[] at = new int[rights + 1];
        for (int r = 0; r < rights; r++) at[r + 1] = at[r] + start[right[r] + 1] - start[right[r]];
        long[][] other = new long[4][at[rights]];
        for (int r = 0; r < rights; r++)
            for (int k = at[r]; k < at[r + 1]; k++)
                for (int w = 0; w < 4; w++) other[w][k] = words[4 * (start[right[r]] + k - at[r]) + w];
        ArrayList out = new ArrayList();
        int[][] row = new int[corners][TILE];
        int[] far = new int[TILE * corners], back = new int[TILE * corners];
        double[] x = new double[corners], y = new double[corners], u = new double[corners], v = new double[corners];
        for (int tile = 0; tile < rights; tile += TILE) {
            int end = Math.min(tile + TILE, rights);
            for (int l = 0; l < lefts; l++) {
                int from = between ? tile : Math.max(tile, l + 1);
                if (from >= end) continue;
                int s = start[left[l]], many = start[left[l] + 1] - s;
                nearest(words, s, many, other[0], other[1], other[2], other[3], at, from, end, far, row, back);
                for (int r = from; r < end; r++) {
                    int t = start[right[r]], base = at[r] - at[from], count = 0;
                    double least = Math.max(LEAST, SHARE * Math.min(many, at[r + 1] - at[r]));
                    for (int i = 0; i < many; i++) {
                        int near = row[i][r - from], j = near & 65535;
                        if (near >> 16 > MOST || (back[base + j] & 65535) != i) continue;
                        x[count] = px[s + i];
                        y[count] = py[s + i];
                        u[count] = px[t + j];
                        v[count++] = py[t + j];
                    }
                    if (count < least) continue;
                    int a = Math.min(left[l], right[r]), b = Math.max(left[l], right[r]);  // the transform leads from the row that comes first
                    int state = a == left[l] ? agreeing(x, y, u, v, count, least, e) : agreeing(u, v, x, y, count, least, e);
                    if (state == 1) {
                        links[a] += size[b];
                        links[b] += size[a];
                        int i = root(above, a), j = root(above, b);
                        above[Math.max(i, j)] = Math.min(i, j);
                    } else if (state == 0) {
                        Row f = (Row) rows.get(a), g = (Row) rows.get(b);
                        out.add(RowFactory.create(new Object[] {f.get(0), g.get(0), f.get(2), g.get(3), f.get(1), g.get(1)}));
                        out.add(RowFactory.create(new Object[] {g.get(0), f.get(0), g.get(2), f.get(3), f.get(1), g.get(1)}));
                    }
                }
            }
        }
        for (int i = 0; i < n; i++) {
            if (links[i] == 0) continue;
            Row r = (Row) rows.get(i);
            out.add(RowFactory.create(new Object[] {r.get(0), ((Row) rows.get(root(above, i))).get(0), r.get(2), Long.valueOf(links[i]), null, null}));
        }
        return out;
    }
}
"""
#: The function's name, and the type of its result.
NAME, RESULT = "wordloom_image_pairs", "a long, b long, pixel_hash binary, links long, x binary, y binary"
_compiled: dict[str, object] = {}


def image_pairs(spark: SparkSession, **constants: float) -> str | None:
    """The name of the function in this session; None where the session has no JVM of its own (Spark Connect).

    The driver compiles it and gives it to the executors as a jar, over Spark's own file server.
    """
    sc = getattr(spark, "_sc", None)
    if sc is None:
        return None
    if sc.applicationId not in _compiled:
        jvm, compiler = sc._jvm, sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(_SOURCE % constants)
        folder = tempfile.mkdtemp(prefix="wordloom-")
        sc._jsc.sc().addJar(_jar(f"{folder}/wordloom_image_pairs.jar", dict(compiler.getBytecodes())))
        _remove_at_exit(folder)
        _compiled[sc.applicationId] = compiler.getClassLoader().loadClass("wordloom.ImagePairs").getConstructor(sc._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(jvm.java.lang.Object, 0))
    result = sc._jvm.org.apache.spark.sql.types.DataType.fromDDL(f"array<struct<{RESULT.replace(' ', ':').replace(',:', ',')}>>")
    spark._jsparkSession.udf().register(NAME, _compiled[sc.applicationId], result)
    return NAME


def _jar(path: str, classes: dict[str, bytes]) -> str:
    with zipfile.ZipFile(path, "w") as z:
        for name, code in classes.items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    return path


def _remove_at_exit(folder: str) -> None:
    import atexit

    atexit.register(shutil.rmtree, folder, ignore_errors=True)
