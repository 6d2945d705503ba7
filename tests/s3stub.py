"""A small S3 endpoint in memory: whole and ranged reads, heads, lists, writes in one piece or in parts, deletes."""

import http.server
import io
import re
import threading
import urllib.parse
from xml.sax.saxutils import escape


def unchunked(f):
    """The bytes of a chunked body; what trails it is read over."""
    out = b""
    while size := int(f.readline().split(b";")[0].strip() or b"0", 16):
        out += f.read(size)
        f.readline()
    while f.readline().strip():
        pass
    return out


class Stub:
    def __init__(self):
        self.objects, self.parts = {}, {}
        stub = self

        class Handler(http.server.BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def log_message(self, *_):
                pass

            def answer(self, status, body=b"", head=False, **headers):
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k.replace("_", "-"), v)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                if not head:
                    self.wfile.write(body)

            def body(self):
                if "chunked" in self.headers.get("Transfer-Encoding", ""):
                    raw = unchunked(self.rfile)
                else:
                    raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                return unchunked(io.BytesIO(raw)) if "STREAMING" in self.headers.get("x-amz-content-sha256", "") or "x-amz-trailer" in self.headers else raw

            def where(self):
                url = urllib.parse.urlsplit(self.path)
                _, bucket, *key = urllib.parse.unquote(url.path).split("/", 2)
                return bucket, "/".join(key), dict(urllib.parse.parse_qsl(url.query, keep_blank_values=True))

            def missing(self, head=False):
                self.answer(404, b"<Error><Code>NoSuchKey</Code></Error>", head)

            def do_GET(self):
                bucket, key, query = self.where()
                if not key:
                    return self.list(bucket, query)
                if (bucket, key) not in stub.objects:
                    return self.missing()
                data = stub.objects[bucket, key]
                if found := re.match(r"bytes=(\d+)-(\d+)", self.headers.get("Range", "")):
                    a, b = int(found[1]), min(int(found[2]), len(data) - 1)
                    return self.answer(206, data[a : b + 1], Content_Range=f"bytes {a}-{b}/{len(data)}")
                self.answer(200, data)

            def do_HEAD(self):
                bucket, key, _ = self.where()
                if key and (bucket, key) not in stub.objects:
                    return self.missing(True)
                self.answer(200, stub.objects.get((bucket, key), b""), True)

            def list(self, bucket, query):
                prefix, cut = query.get("prefix", ""), query.get("delimiter", "")
                keys = sorted(k for b, k in stub.objects if b == bucket and k.startswith(prefix))
                tops = sorted({prefix + k[len(prefix) :].split(cut)[0] + cut for k in keys if cut and cut in k[len(prefix) :]})
                keys = [k for k in keys if not cut or cut not in k[len(prefix) :]][: int(query.get("max-keys", 1000))]
                rows = "".join(f"<Contents><Key>{escape(k)}</Key><Size>{len(stub.objects[bucket, k])}</Size><LastModified>2024-01-01T00:00:00.000Z</LastModified></Contents>" for k in keys)
                rows += "".join(f"<CommonPrefixes><Prefix>{escape(t)}</Prefix></CommonPrefixes>" for t in tops)
                self.answer(200, f"<ListBucketResult><IsTruncated>false</IsTruncated><KeyCount>{len(keys) + len(tops)}</KeyCount>{rows}</ListBucketResult>".encode())

            def do_PUT(self):
                bucket, key, query = self.where()
                data = self.body()
                if "partNumber" in query:
                    stub.parts.setdefault(query["uploadId"], {})[int(query["partNumber"])] = data
                else:
                    stub.objects[bucket, key] = data
                self.answer(200, ETag='"x"')

            def do_POST(self):
                bucket, key, query = self.where()
                self.body()
                if "uploads" in query:
                    return self.answer(200, f"<InitiateMultipartUploadResult><UploadId>{key}</UploadId></InitiateMultipartUploadResult>".encode())
                stub.objects[bucket, key] = b"".join(x for _, x in sorted(stub.parts.pop(query["uploadId"], {}).items()))
                self.answer(200, b"<CompleteMultipartUploadResult><ETag>x</ETag></CompleteMultipartUploadResult>")

            def do_DELETE(self):
                bucket, key, _ = self.where()
                stub.objects.pop((bucket, key), None)
                self.answer(204)

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"
