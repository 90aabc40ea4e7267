"""License notices that are wrapped over several lines."""

import textwrap

from mailquarry.llm import licenses

LONG = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
}


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.scanned(docs).collect()}


def test_wrapped_notices_are_found(spark):
    texts = ["Title\n\n" + "\n".join(prefix + line for line in textwrap.wrap("Copyright Ann. " + text + " More words follow here.", width, break_long_words=False)) + "\n\nend"
             for text in LONG.values() for width, prefix in ((75, ""), (40, " * "), (8, "# "))]
    got = labels(spark, texts)
    for at, label in enumerate(LONG):
        assert all(label in got[3 * at + k] for k in range(3)), label


def test_far_apart_words_are_not_a_notice(spark):
    words = "released under the mit license".split()
    filler = "other words stand here and fill this line up"
    apart = "\n".join(f"{w}\n{filler}" for w in words)
    paragraphs = "released under\n\nthe mit license"
    got = labels(spark, [apart, paragraphs, "released under\nthe mit license"])
    assert got == {0: set(), 1: set(), 2: {"mit"}}
