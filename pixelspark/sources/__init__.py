"""Container readers and writers: RIFF/WebP, TIFF/IFD, PNG and ISOBMFF, over ``binaryFile`` scans."""
