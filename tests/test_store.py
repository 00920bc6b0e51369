from notewright.operators import store


def test_saving_again_replaces_one_song(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "song_id long, title string")
    store.save(rows((1, "a"), (2, "b"), (3, "c")), root, "songs", 2)
    store.save(rows((2, "new"), (9, "z")), root, "songs", 2)
    assert sorted(tuple(r) for r in store.load(spark, root, "songs").collect()) == [(1, "a"), (2, "new"), (3, "c"), (9, "z")]
    assert store.load(spark, root, "songs", 2, 2).first().title == "new"
    for song in (1, 2, 3, 9):
        store.delete(spark, root, song, 2)
    meta = spark.createDataFrame([], "song_id long, artist string")
    assert store.listing(store.load(spark, root, "songs"), meta).count() == 0


def test_listing_keeps_songs_without_metadata(spark):
    songs = spark.createDataFrame([(1, "a"), (2, "b")], "song_id long, title string")
    meta = spark.createDataFrame([(1, "Queen")], "song_id long, artist string")
    assert store.listing(songs, meta).count() == 2
    assert [r.song_id for r in store.listing(songs, meta, "queen").collect()] == [1]
