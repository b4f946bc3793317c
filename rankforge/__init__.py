"""Two analytics jobs on Spark DataFrames: most active users, items for a user."""

from rankforge.plans.recommend import (
    Recommender,
    fit_model,
    load_recommender,
    publish_recommender,
    recommend,
    run_recommend,
    run_serve,
    serve,
    train_recommender,
)
from rankforge.plans.top_users import run_top_users, top_users
from rankforge.session import build_session, owned_folders

__all__ = [
    "Recommender",
    "build_session",
    "fit_model",
    "load_recommender",
    "owned_folders",
    "publish_recommender",
    "recommend",
    "run_recommend",
    "run_serve",
    "run_top_users",
    "serve",
    "top_users",
    "train_recommender",
]
