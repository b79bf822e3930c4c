"""tidelog.operators"""
